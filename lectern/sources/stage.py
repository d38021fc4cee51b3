"""Materialised steps: tables in the shared folder, and stages that are skipped where their result exists (SNK-11)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only where that is unset, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lectern-stage-"))


def stored(df: DataFrame, tag: str = "step") -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/lectern-{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """What runs meanwhile sends rows to Python in batches of about ``most`` bytes, one row at least.

    Spark holds a batch several times for each task, and Python once more. The setting is read when a plan runs, so
    results must be written before this ends.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a path, sorted; none where it doesn't exist."""
    if not exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(f.getPath().getName() for f in found if f.isDirectory())


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The table at ``path``, made and written first if no finished one is there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Consecutive numbers from 0 in the order of the columns, without a window over all rows.

    Rows are dealt by range and sorted within; of each part only its row count
    reaches the driver. Ties get numbers in no particular order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    dealt = dealt.withColumn("_part", F.shiftright("_m", 33).cast("int")).withColumn("_at", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    before, so_far = [], 0
    for part, n in sorted(dealt.groupBy("_part").count().collect()):
        before.append((part, so_far))
        so_far += n
    table = spark.createDataFrame(before or [(0, 0)], "_part int, _before long")
    return dealt.join(F.broadcast(table), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_m", "_part", "_at", "_before")
