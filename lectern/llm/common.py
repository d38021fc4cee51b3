"""Shared pieces of the training-data operators: words, folds and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: U+0020 and U+0009 to U+000D.
_BLANKS = "\t\n\x0b\x0c\r"
_own_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), _BLANKS, " " * len(_BLANKS))
    return F.array_remove(F.split(plain, " "), "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the documents that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what ``spark.checkpoint.dir`` names. Where that is unset, a local run
    makes a folder of its own, once for each application; a cluster's run fails.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lectern-")
    return _own_dirs[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lectern-{tag}-{uuid.uuid4().hex[:12]}"


def _written(df: DataFrame, path: str, compression: str) -> DataFrame:
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, a lost executor costs nothing."""
    return _written(df, new_folder(df.sparkSession, tag), compression)


class Tables:
    """Stored tables of one computation; all but those kept are deleted when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.own = spark, []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*[t for t, _ in self.own])

    def store(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_folder(self.spark, tag)
        self.own.append((_written(df, path, "zstd"), path))
        return self.own[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        gone = [x for x in self.own if any(x[0] is t for t in tables)]
        self.own = [x for x in self.own if not any(x[0] is t for t in tables)]
        for _, path in gone:
            dropped(self.spark, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs meanwhile sends rows to Python in batches of about ``most`` bytes, one row at least.

    Spark holds a batch several times outside the heap, in doubling buffers, for each task. The setting is read when a
    plan runs, so results must be written before this ends.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
