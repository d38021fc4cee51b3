"""Queries over readers and writers: each writes a table in some form to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.catalog import query
from lectern.plans.retrieval import found, table
from lectern.sources import readers as R
from lectern.sources import writers as W
from lectern.sources.stage import shared_folder, stage
from lectern.streaming import incremental as I


def folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/lectern-{tag}-{uuid.uuid4().hex[:12]}"


@query("src05_10_json_lines", "SELECT doc_id, lang, length(text)::INTEGER AS len FROM documents")
def src05(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "jsonl")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.json(path)
    return R.json_lines(spark, path, "doc_id long, lang string, text string").select("doc_id", "lang", F.length("text").alias("len"))


@query("src06_07_json_maps", "SELECT source || '/' || doc_id AS source_file, lang, n_chars FROM documents")
def src06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of books for each source, as one line of its own file."""
    path = folder(spark, "maps")
    d = table(spark, sf_dir, "documents")
    entry = F.map_from_arrays(F.array(F.concat_ws("/", "source", F.col("doc_id").cast("string"))), F.array(F.struct("lang", "n_chars")))
    d.select(F.to_json(entry).alias("value"), "lang").write.partitionBy("lang").text(path)
    maps = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,struct<lang:string,n_chars:bigint>>")).alias("source_file", "entry"))
    return maps.select("source_file", "entry.*")


@query("src15_28_keys_from_paths", "SELECT lang AS split, source, count(*) AS n FROM documents GROUP BY 1, 2")
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tree")
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("a"), F.col("source").alias("b"), "doc_id")
    d.write.partitionBy("a", "b").json(path)
    rows = spark.read.schema("doc_id long").option("recursiveFileLookup", "true").json(path).select(F.col("_metadata.file_path").alias("path"), "doc_id")
    keyed = R.keyed_by_path(rows, path, ("split", "source"))
    bare = lambda c: F.regexp_replace(c, "^[ab]=", "")
    return keyed.select(bare("split").alias("split"), bare("source").alias("source")).groupBy("split", "source").agg(F.count("*").alias("n"))


@query("src22_snk10_csv", "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def src22(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal")).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="s_suppkey long, s_name string, s_acctbal double")


@query("src21_pruned_token_scan", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def src21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("src24_preset_scan", "SELECT * FROM (VALUES ('small', '5'), ('large', '20')) t(name, top_k)")
def src24(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"presets": [{"name": "small", "params": {"top_k": 5}}, {"name": "other"}, {"name": "large", "params": {"top_k": 20}}]}'
    return R.presets(spark, text, ["small", "large"]).select("name", F.col("params")["top_k"].alias("top_k"))


@query("snk01_partitioned_chunks", "SELECT lang AS split, count(*) AS n FROM documents GROUP BY 1")
def snk01(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "chunks")
    W.write_stage(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))


@query("snk02_chunk_meta", "SELECT lang AS split, count(*) AS chunks_num, round(sum(n_chars) / 1000.0, 4)::DOUBLE AS total_chunking_time, (sum(n_chars) // count(*))::BIGINT AS avg_token_len FROM documents GROUP BY 1")
def snk02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), F.col("n_chars").alias("tokens_len"), (F.col("n_chars") / 1000).alias("chunking_time"))
    return W.chunk_meta(d).withColumn("total_chunking_time", F.round("total_chunking_time", 4))


@query("snk04_nested_results")
def snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = W.nested(found(spark, sf_dir))
    return n.select("qid", F.size("chunks").alias("n"), F.get("chunks", F.lit(0)).alias("first"))


@query("snk11_stage_cache", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def snk11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "stage")
    make = lambda: table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    stage(spark, path, make)
    return stage(spark, path, lambda: make().where("false"))  # the second call must not make anything


@query("st00_incremental_chunks")
def st00(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = folder(spark, "stream")
    I.chunk_new_books(spark, f"{sf_dir}/documents*.parquet", target, f"{target}-checkpoint", "fixed_size", {"chunk_size": 800, "overlap": 100})
    return spark.read.parquet(target).select("source_file", "chunk_no", "start_index", "end_index")


@query("st00_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st00w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.windowed_counts(table(spark, sf_dir, "events"), "1 hour", "10 minutes").withColumn("total", F.round("total", 4))
