"""Readers of an experiment's file trees, as tables with ordinary key columns.

Paths go to Spark's readers alone, so any file system it knows will do. What a
directory tree says by its names is parsed from the file path.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.stage import exists, folders

CHUNK_SCHEMA = "source_file string, chunk_id long, start_index int, end_index int, tokens_len int, text string, split string, chunking_method string, chunking_params map<string,string>, chunking_time double"
TASK = "struct<Question:string,Answers:string,Options:array<string>,Aspect:string,Complexity:string>"
RESULT_KEYS = ("dataset", "preset", "chunking", "chunking_preset", "embed", "embed_preset", "search", "search_preset", "rerank", "rerank_preset", "split")
JUDGE_KEYS = (*RESULT_KEYS[:-1], "generator", "generator_preset", "judge", "judge_preset", "split")
#: Folders that are splits, as fixed values; the merged split takes a file from the first of MERGED that has it.
SPLITS = ("train", "test", "validation", "example", "examples")
MERGED = ("all", "train", "test", "validation")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines; blank lines are skipped and rows that don't parse are dropped (SRC-5, SRC-10)."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schema).alias("r"), F.try_parse_json("value").alias("ok")).where("ok is not null").select("r.*")


def json_map(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """Files that hold one map each: a row for each entry, with the file's name (SRC-6, SRC-14)."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "entry"))


def file_stem(path: Column) -> Column:
    """The file's name without folders, ending, and the marks .cleaned and .tagmap (DD-12)."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(\.cleaned|\.tagmap)?\.[A-Za-z0-9]+$", "")


def keyed_by_path(df: DataFrame, root: str, names: tuple[str, ...] = RESULT_KEYS, path: str = "path") -> DataFrame:
    """Columns for the folders under a root; files at any other depth are dropped (SRC-15, SRC-28)."""
    rest = F.split(F.substring_index(path, f"{root.rstrip('/')}/", -1), "/")
    fit = df.withColumn("_p", rest).where(F.size("_p") == len(names) + 1)
    return fit.select(*[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)], *df.columns)


def books(spark: SparkSession, path: str) -> DataFrame:
    """source_file, split (the folder) and text of every text file (SRC-25)."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(file_stem(F.col("path")).alias("source_file"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("split"), "text")


def tasks(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Questions of a split: choice_qa if it is there, else open_qa; an error if neither is (SRC-8). Answers is always a list."""
    for kind in ("choice_qa", "open_qa"):
        path = f"{root}/Tasks/{kind}/{split}"
        if exists(spark, path):
            t = json_map(spark, path, TASK, "question_id").select(file_stem(F.col("path")).alias("source_file"), "question_id", "entry.*")
            many = F.from_json("Answers", "array<string>")
            return t.withColumn("Answers", F.coalesce(F.when(F.col("Answers").startswith("["), many), F.array("Answers")))
    raise FileNotFoundError(f"no tasks of split {split!r} under {root}")


def tasks_of(spark: SparkSession, data_dir: str, configs: list[tuple[str, str, str]]) -> DataFrame:
    """Questions of several (dataset, preset, split), side by side with these keys; no configs give no rows (SRC-9)."""
    out = spark.createDataFrame([], f"dataset string, preset string, split string, source_file string, question_id string, {TASK[7:-1]}".replace("Answers:string", "Answers:array<string>").replace(":", " "))
    for dataset, preset, split in configs:
        t = tasks(spark, f"{data_dir}/{dataset}/{preset}", split)
        out = out.unionByName(t.select(F.lit(dataset).alias("dataset"), F.lit(preset).alias("preset"), F.lit(split).alias("split"), *t.columns))
    return out


def available_chunkers(spark: SparkSession, base: str) -> list[tuple[str, str]]:
    """The (chunker, preset) folders that a tree holds (SRC-26)."""
    return [(c, p) for c in folders(spark, base) for p in folders(spark, f"{base}/{c}")]


def available_splits(spark: SparkSession, base: str, chunker: str, preset: str) -> set[str]:
    """The splits with an analysis of split points by tags or by sentences (SRC-26)."""
    where = f"{base}/{chunker}/{preset}/analyze_split_point"
    return {s for kind in ("html_tag", "sentence") for s in folders(spark, f"{where}/{kind}")} & set(SPLITS)


def merged_tree(spark: SparkSession, parent: str) -> DataFrame:
    """relative_path, split and path of the files that the merged split of a folder holds, the first split's of each path (SNK-12).

    A file that stands in ``all`` already stays. Paths alone are read, never contents; no splits give no rows.
    """
    here = [s for s in folders(spark, parent) if s in MERGED]
    if not set(here) - {"all"}:
        return spark.createDataFrame([], "relative_path string, split string, path string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{parent}/{s}" for s in here]).select("path")
    under = rf"^.*?{re.escape(parent.rstrip('/'))}/([^/]+)/(.*)$"
    rest = files.select("path", F.regexp_extract("path", under, 1).alias("split"), F.regexp_extract("path", under, 2).alias("relative_path"))
    rank = F.array_position(F.array(*map(F.lit, MERGED)), F.col("split"))
    return rest.groupBy("relative_path").agg(F.min(F.struct(rank.alias("rank"), "split", "path")).alias("m")).select("relative_path", "m.split", "m.path")


def verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Keys, question_id and value (1 if judged correct) of every judged question of a result tree (SRC-16).

    Files at another depth, files that don't parse and questions without a verdict are left out.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="generation_results.json").select(F.col("_metadata.file_path").alias("path"), "value")
    judged = keyed_by_path(files, root, JUDGE_KEYS).select(*JUDGE_KEYS, F.explode(F.from_json("value", "map<string,struct<verdict:string>>")).alias("question_id", "entry"))
    return judged.where("entry.verdict is not null").select(*JUDGE_KEYS, "question_id", (F.col("entry.verdict") == "correct").cast("int").alias("value"))


def metadata(spark: SparkSession, paths: list[str], value: str) -> DataFrame:
    """Book metadata of several data sets, side by side by name (SRC-6, SRC-7)."""
    frames = [json_map(spark, p, value, "source_file").select("source_file", "entry.*") for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """path, id (the row) and embedding of every matrix file (SRC-11)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for p in parts:
            for where, content in zip(p["path"], p["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for at in range(0, len(m), 4096):
                    yield pd.DataFrame({"path": where, "id": np.arange(at, min(at + 4096, len(m))), "embedding": list(m[at : at + 4096])})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, id long, embedding array<float>")


def embeddings(spark: SparkSession, metadata_path: str, vectors_path: str) -> DataFrame:
    """Metadata joined to vectors by row id; rows without a vector are left out (SRC-11, SRC-12, J-19)."""
    m = json_lines(spark, metadata_path, "id long, source_file string, chunk_id long, embed_time double")
    return m.join(npy_vectors(spark, vectors_path).select("id", "embedding"), "id")


def retrieval_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics with the cumulative accuracies as columns (SRC-13)."""
    m = spark.read.schema("`Accuracy@1` double, `Accuracy@1-5` array<double>, `Recall@10` double, `MRR@10` double, `NDCG@10` double").json(path, multiLine=True, recursiveFileLookup=True)
    return m.select(*[F.get("Accuracy@1-5", F.lit(i)).alias(f"accuracy_at_{i + 1}") for i in range(5)], F.col("`Recall@10`").alias("recall"), F.col("`MRR@10`").alias("mrr"), F.col("`NDCG@10`").alias("ndcg"))


def presets(spark: SparkSession, text: str, use: list[str] | None = None) -> DataFrame:
    """name and params of presets (JSON, or YAML where a parser is installed); a missing name is an error (SRC-24)."""
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    rows = [(p["name"], {k: str(v) for k, v in (p.get("params") or {}).items()}) for p in found["presets"]]
    if use is not None:
        if missing := set(use) - {n for n, _ in rows}:
            raise ValueError(f"no presets named {sorted(missing)}")
        rows = [r for r in rows if r[0] in set(use)]
    return spark.createDataFrame(rows, "name string, params map<string,string>")
