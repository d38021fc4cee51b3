"""Roll-ups of results over configurations: verdict ratios, pivots, extremes, summary rows, quartiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def verdict_ratio(rows: DataFrame, verdict: str, *keys: str, all_questions: bool = False) -> DataFrame:
    """Percent of correct verdicts; rows without one don't count unless all questions do (AG-7, AG-7b)."""
    n = F.count("*") if all_questions else F.count(verdict)
    out = rows.groupBy(*keys).agg((100 * F.count_if(F.col(verdict) == "correct") / F.nullif(n, F.lit(0))).alias("ratio"), n.alias("n"))
    return out.where("n > 0")


def extremes(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """metric, max_key, max_value, min_key and min_value; of ties the first key wins (AG-14)."""
    long = df.unpivot([key], metrics, "metric", "value").where("value is not null")
    hi, lo = F.min(F.struct((-F.col("value")).alias("v"), F.col(key).alias("k"))), F.min(F.struct(F.col("value").alias("v"), F.col(key).alias("k")))
    g = long.groupBy("metric").agg(hi.alias("hi"), lo.alias("lo"))
    return g.select("metric", F.col("hi.k").alias("max_key"), (-F.col("hi.v")).alias("max_value"), F.col("lo.k").alias("min_key"), F.col("lo.v").alias("min_value"))


def with_average_row(df: DataFrame, key: str, metrics: list[str], name: str = "AVG") -> DataFrame:
    """The table and a row of column means (AG-16)."""
    return df.select(key, *metrics).unionByName(df.agg(*[F.avg(m).alias(m) for m in metrics]).withColumn(key, F.lit(name)))


def box_plot(df: DataFrame, value: str, *keys: str, exact: bool = True) -> DataFrame:
    """Quartiles and whiskers of a column (AG-12); approximate quartiles at scale."""
    q = lambda p: F.percentile(value, p) if exact else F.percentile_approx(value, p, 10000)
    g = df.groupBy(*keys).agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(g.select(*keys, low.alias("_lo"), high.alias("_hi")), list(keys)).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    ends = inside.groupBy(*keys).agg(F.min(value).alias("whisker_low"), F.max(value).alias("whisker_high"))
    return g.join(ends, list(keys))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n over equal widths between least and most (AG-20)."""
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    b = F.least(F.floor((F.col(value) - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0)) * bins), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(b, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row of ends


def pivoted(df: DataFrame, keys: list[str], column: str, values: list, agg: Column, fill: float | int | None = None) -> DataFrame:
    """One column for each given value, in that order (PV-1 to PV-4)."""
    out = df.groupBy(*keys).pivot(column, values).agg(agg)
    return out if fill is None else out.fillna(fill)


def row_percent(df: DataFrame, columns: list[str]) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(c) for c in columns])
    return df.withColumns({c: F.round(F.try_divide(100 * F.col(c), total), 4) for c in columns})


def outer_joined(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """All tables side by side by key, whichever has it (J-14)."""
    return reduce(lambda a, b: a.join(b, keys, "outer"), frames)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that fails where the right side has a key twice (J-1)."""
    n = F.count("*")
    columns = [c for c in right.columns if c not in keys]
    once = right.groupBy(*keys).agg(*[F.first(c).alias(c) for c in columns], n.alias("_n"))
    ok = F.when(F.coalesce("_n", F.lit(1)) > 1, F.raise_error(F.lit("keys of the right side repeat")).cast("boolean")).otherwise(F.lit(True))
    return left.join(once, keys, "left").where(ok).drop("_n")


def strictly_joined(left: DataFrame, right: DataFrame, keys: list[str], probe: str) -> DataFrame:
    """A join that fails where the right side has no partner (J-22)."""
    j = left.join(right, keys, "left")
    return j.where(F.when(F.col(probe).isNull(), F.raise_error(F.lit("a row has no partner")).cast("boolean")).otherwise(F.lit(True)))


def grid(*presets: DataFrame) -> DataFrame:
    """Every combination of small preset tables (J-20)."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), presets)


def by_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Sorted by a given order of values, others last (TK-6)."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(at > 0, at).otherwise(len(order) + 1), column)
