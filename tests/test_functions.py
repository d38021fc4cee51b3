"""Edge rows of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import boundary as B
from lectern.functions import text as T
from lectern.functions import vector as V


def values(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_trim_bounds_has_an_inclusive_end(spark):
    rows = [("  a\n\t",), ("",), (" x",), ("x",), (" y ",)]
    out = values(spark, "s string", rows, T.trim_bounds(F.col("s"), F.lit(10), F.lit(10) + F.length("s")))
    assert [tuple(r) for r in out] == [("a", 12, 12), ("", 10, 9), ("x", 11, 11), ("x", 10, 10), ("y", 11, 11)]


@pytest.mark.parametrize(
    "raw,answer",
    [
        ("Answer: B", "B"), ("<think>Answer: A</think> Answer: C", "C"), ("x Answer: A then Answer: B", "A then Answer: B"),
        ("", ""), ("no marker", "no marker"), ("<think>a</think>", "<think>a</think>"), ("ANSWERS :  x\ny ", "x\ny"),
    ],
)
def test_extract_answer(spark, raw, answer):
    assert values(spark, "s string", [(raw,)], T.extract_answer(F.col("s"))) == [answer]


@pytest.mark.parametrize(
    "raw,verdict",
    [("Verdict: correct", "correct"), ("Verdict: correct … incorrect", "incorrect"), (None, "incorrect"), ("", "incorrect"), ("it is correct", "correct"), ("Verdict: dunno", "incorrect")],
)
def test_extract_verdict(spark, raw, verdict):
    assert values(spark, "s string", [(raw,)], T.extract_verdict(F.col("s"))) == [verdict]


def test_map_option(spark):
    rows = [("b", ["x", "y"]), ("Z", ["x", "y"]), ("AB", ["x", "y"]), ("A", None)]
    assert values(spark, "a string, o array<string>", rows, T.map_option(F.col("a"), F.col("o"))) == ["y", "Z", "AB", "A"]


def test_years(spark):
    rows = [(y,) for y in ("1853-1857", "L.M. Foo 1828", "1900.0", "Unknown", "ann", None)]
    assert values(spark, "y string", rows, T.clean_year(F.col("y"))) == [1853, 1828, 1900, None, None, None]
    assert values(spark, "y string", rows, T.best_year(F.col("y"), F.lit("1700"))) == [1853, 1828, 1900, None, 1700, 1700]


def test_genres_words_and_keys(spark):
    assert values(spark, "g string", [(" a ; ;b",), ("",), (None,)], T.genre_tags(F.col("g"))) == [["a", "b"], [], []]
    assert values(spark, "s string", [("",), ("a b",), (" a  b c ",)], T.word_count(F.col("s"))) == [0, 2, 4]
    with pytest.raises(Exception, match="without four parts"):
        values(spark, "k string", [("a-b-c",)], T.key_parts(F.col("k")))


@pytest.mark.parametrize(
    "before,between,after,good",
    [
        ("End.", " ", "Next", True), ("end", " ", "next", False), ("He said:", " ", "Yes", True), ("a!", " ", "b", True), ("\nIV", "\n", "x", True),
        ('x—"', "", "y", True), ("a", "\n\n", "b", True), ("A.", "é", "B", True), ("A.", "x", "B", False), ("", " ", "B", False), ("a;", " ", "'b", True), ("a", "", "—b", True),
    ],
)
def test_good_boundary(spark, before, between, after, good):
    rows = [(before, between, after)]
    assert values(spark, "a string, b string, c string", rows, B.good_boundary(F.col("a"), F.col("b"), F.col("c"))) == [good]


def test_vectors(spark):
    rows = [([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 1.0])]
    schema = "a array<double>, b array<double>"
    assert values(spark, schema, rows, V.cosine(F.col("a"), F.col("b"))) == pytest.approx([0, 0.5**0.5])
    assert values(spark, schema, rows, V.normalised(F.col("b")))[0] == [0, 0]
    assert values(spark, "n int", [(20,), (21,)], V.size_factor(F.col("n"))) == pytest.approx([1 / (1 + math.exp(-20)), math.log1p(math.exp(0.5)) / math.log(2)])


def test_numbers_print_as_in_c(spark):
    """Halves, near halves, signs and large numbers against C's own rounding."""
    import random
    import struct

    rng = random.Random(4)
    xs = [0.125, 0.375, 1.005, 2.675, 0.005, 0.015, -0.125, -0.001, -0.0, 0.0, 59.995, 12.5, 6.25, 1e-300, 999999.995, 2.0**46 + 0.015625, 2.0**52 + 0.5, 2.0**53 + 2, 3.0**33, 4.5e16]
    xs += [k / 8 for k in range(400)] + [rng.uniform(0, 1e6) for _ in range(2000)] + [k * 0.7137 for k in range(0, 3_000_000, 997)]
    xs += [x for x in (struct.unpack("d", struct.pack("q", rng.getrandbits(63)))[0] for _ in range(3000)) if x < 4e16]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.fixed_point(F.col("x"), 2).alias("two"), T.fixed_point(F.col("x"), 1).alias("one"))
    for x, two, one in df.collect():
        assert (two, one) == (f"{x:.2f}", f"{x:.1f}"), x
    df = spark.createDataFrame([(0.125,), (450.3,), (7218.0,), (None,)], "x double")
    assert [r[0] for r in df.select(T.format_seconds(F.col("x"))).collect()] == ["0.12 s", "7.50 min", "2.00 h", ""]
    assert spark.range(1).select(T.percent(F.lit(1), F.lit(16)).alias("a"), T.percent(F.lit(None).cast("int"), F.lit(16)).alias("b")).first() == ("6.2%", None)
