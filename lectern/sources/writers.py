"""Writers: partitioned tables, one table for each stage's result, and small exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys by which a stage's table is partitioned; further keys are ordinary columns.
PARTITION_KEYS = ("dataset", "chunking", "split")


def write_stage(df: DataFrame, path: str, keys: tuple[str, ...] = PARTITION_KEYS, mode: str = "overwrite") -> None:
    """A stage's table (SNK-1, 3 to 8). Only partitions that the data touch are replaced, and one partition's rows come in several files."""
    here = [k for k in keys if k in df.columns]
    df.write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy(*here).parquet(path)


def write_json_lines(df: DataFrame, path: str, *keys: str) -> None:
    df.write.mode("overwrite").partitionBy(*keys).json(path)


def chunk_meta(chunks: DataFrame) -> DataFrame:
    """Per split: chunks_num, total_chunking_time and avg_token_len, whole (SNK-2)."""
    return chunks.groupBy("split").agg(F.count("*").alias("chunks_num"), F.sum("chunking_time").alias("total_chunking_time"), F.floor(F.try_divide(F.sum("tokens_len"), F.count("*"))).alias("avg_token_len"))


def nested(found: DataFrame) -> DataFrame:
    """Search results with their ranks as lists, one row per question (SNK-4)."""
    hits = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "distance")))  # k rows a question
    g = found.groupBy("qid").agg(hits.alias("h"))
    return g.select("qid", F.transform("h", lambda x: x["chunk_id"]).alias("chunks"), F.transform("h", lambda x: x["distance"]).alias("distances"))


def latex(df: DataFrame, most: int = 500) -> str:
    """A small result as a LaTeX table (SNK-10)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda xs: " & ".join("" if x is None else str(x) for x in xs) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", line(df.columns), r"\hline", *[line(r) for r in rows], r"\end{tabular}"])
