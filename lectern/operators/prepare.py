"""Preparing a corpus: duplicates, splits, ids, statistics, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.stage import numbered

SPLITS = ("train", "validation", "test")


def dedup(df: DataFrame, keys: list[Column], id_column: str) -> DataFrame:
    """One row for each distinct key: new_id (dense, in first-seen order), first_id, n_old and the key's digest (DD-1, DD-2)."""
    digest = F.sha2(F.concat_ws("\x1f", *[k.cast("string") for k in keys]), 256)
    groups = df.where(F.col(id_column).isNotNull()).groupBy(digest.alias("digest")).agg(F.min(id_column).alias("first_id"), F.count("*").alias("n_old"))
    return numbered(groups, "first_id", name="new_id")


def old_to_new(df: DataFrame, keys: list[Column], id_column: str, groups: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat_ws("\x1f", *[k.cast("string") for k in keys]), 256)
    return df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("old_id"), digest.alias("digest")).join(groups.select("digest", "new_id"), "digest").drop("digest")


def split_assigned(books: DataFrame, id_column: str, test: float = 0.2, validation: float = 0.1) -> DataFrame:
    """Splits by hash order with whole counts, test first, then validation; examples are the first of train (DD-3, DD-4)."""
    n = books.count()
    n_test, n_val = int(n * test), int(n * validation)
    rows = numbered(books.withColumn("_h", F.md5(F.col(id_column).cast("string"))), "_h", id_column, name="_r").drop("_h")
    split = F.when(F.col("_r") < n_test, "test").when(F.col("_r") < n_test + n_val, "validation").otherwise("train")
    at = F.col("_r") - (n_test + n_val)
    rows = rows.withColumn("split", split).withColumn("example", (at >= 0) & (at < 1)).withColumn("examples", (at >= 0) & (at < 3))
    return rows.drop("_r")


def corpus_stats(books: DataFrame, tokens: str, tasks: DataFrame) -> DataFrame:
    """docs_count, tasks_count, avg_token_len (whole) and the count of each split (DD-11)."""
    b = books.agg(
        F.count("*").alias("docs_count"),
        F.floor(F.try_divide(F.sum(tokens), F.count("*"))).alias("avg_token_len"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS],
    )
    return b.crossJoin(tasks.agg(F.count("*").alias("tasks_count")))  # one row each


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id 0 to N-1 over train, test and validation, books by name, chunks by position (DD-14, WN-8)."""
    rank = F.array_position(F.array(F.lit("train"), F.lit("test"), F.lit("validation")), F.col("split"))
    return numbered(chunks.withColumn("_s", rank), "_s", "source_file", "start_index", name="chunk_id").drop("_s")


def merged_meta(meta: DataFrame) -> DataFrame:
    """Sums over splits with train's method; fails where train is missing (DD-15). meta: method, split, total_time, chunks_num, avg_token_len."""
    m = meta.groupBy("method").agg(
        F.sum("total_time").alias("total_time"), F.sum("chunks_num").alias("chunks_num"),
        F.round(F.try_divide(F.sum(F.col("avg_token_len") * F.col("chunks_num")), F.sum("chunks_num")), 6).alias("avg_token_len"),
        F.bool_or(F.col("split") == "train").alias("_train"),
    )
    return m.withColumn("chunks_num", F.when(F.col("_train"), F.col("chunks_num")).otherwise(F.raise_error(F.lit("no train split")).cast("long"))).drop("_train")


def stratified(df: DataFrame, label: str, id_column: str, k: int) -> DataFrame:
    """At most k rows of each label by hash order (DD-16): the sampling operator.

    A label's rows are first thinned within each partition of the input, so no label is gathered whole.
    """
    keyed = df.withColumn("_h", F.md5(F.col(id_column).cast("string"))).withColumn("_p", F.spark_partition_id())
    order = lambda *p: F.row_number().over(Window.partitionBy(*p).orderBy("_h", id_column))
    near = keyed.withColumn("_k", order(label, "_p")).where(F.col("_k") <= k)
    return near.withColumn("_k", order(label)).where(F.col("_k") <= k).drop("_h", "_p", "_k")


def capped(df: DataFrame, id_column: str, n: int) -> DataFrame:
    """n rows by hash order (DD-17): the sampling operator."""
    return df.orderBy(F.md5(F.col(id_column).cast("string")), id_column).limit(n)
