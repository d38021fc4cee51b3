"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Column that is true for a document to reject, written over
measures that are computed when a rule asks for them. A bounded sample gives
every rule's selectivity and cost; the rules, the base ones among them, then
run in the order of rejections per cost inside one CASE expression that stops
at the first hit, so a document pays for no rule behind the one that rejects
it. The verdict does not depend on that order, only the work does. ``report``
returns measures and therefore computes them for every row.

Defined results: null and empty texts have no words and fail the base rule;
texts count whole, whatever their length; repeated rows are judged each by
itself; an empty table gives an empty result; columns of the input keep their
names and values, whatever they are called, since the input row travels in a
struct of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Rows of the sample from which costs and selectivities are estimated, and how often a rule is timed over it.
SAMPLE_ROWS, TIMES = 2000, 3
_BLANK = r"\x20\x09-\x0D"

Measures = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], Column]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, wherever the optimizer moves or copies the expression.

    A plain column that an inner lambda reads could be replaced by its definition and computed for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """How many of the words lie in a window of three words found at least twice, the first occurrence included.

    Equal windows meet by their 64-bit hashes within the row, so nothing is shuffled. Only where some are equal are they sorted.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    placed = lambda hs: F.transform(hs, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    same = lambda s, x, i: F.get(s, i)["h"] == x["h"]
    places = lambda s: F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["p"])
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    add = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    covered = lambda hs: F.aggregate(F.sort_array(_bound(F.sort_array(placed(hs)), places)), start, add, lambda a: a["n"])
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(_bound(windows, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs))))


def _split(docs: DataFrame, text: str) -> DataFrame:
    """``_row`` (the input row), ``_t`` (its text) and ``_w`` (its words)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), t.alias("_t"))
    return _once(row, _w=words(F.col("_t")))


def _once(df: DataFrame, **more: Column) -> DataFrame:
    """The table with columns that stay where they are computed, once a row.

    The id, which is never negative, keeps filters above them. (A bound on rand() is folded away.)
    """
    held = df.withColumn("_m", F.when(F.monotonically_increasing_id() >= 0, F.struct(*[c.alias(n) for n, c in more.items()])))
    return held.select(*df.columns, *[F.col(f"_m.{n}").alias(n) for n in more])


def definitions() -> dict[str, Column]:
    """Each measure as an expression over ``_t`` and ``_w``."""
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    without = lambda pattern: F.length(F.regexp_replace("_t", pattern, ""))
    dots = F.size(F.filter("_w", lambda w: w.endswith("...") | w.endswith("…")))
    return {
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "lines": _bound(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
        "n_repeat_words": _bound(F.col("_w"), _repeat_words).cast("long"),
        # Words with a letter: one match from each word's start to its first letter.
        "lettered": F.regexp_count("_t", F.lit(rf"(?<![^{_BLANK}])[^{_BLANK}\p{{L}}]*+\p{{L}}")),
        "capitals": F.length("_t") - without(r"\p{Lu}+"),
        "small": without(r"[^\p{Ll}]+"),
        "dotted": F.when(F.col("_t").contains("...") | F.col("_t").contains("…"), dots).otherwise(F.lit(0)),
    }


#: Measures that ``report`` computes for every row.
_REPORTED = ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda m: m["n_words"] < MIN_WORDS),
        Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"]),
    ]


def default_rules() -> list[Rule]:
    """Rules beside the base ones; each holds for every text size."""
    return [
        Rule("symbols_per_word", lambda m: 10 * m["n_symbols"] > m["n_words"]),
        Rule("mean_word_length", lambda m: _bound(m["word_chars"], lambda c: (c < 2 * m["n_words"]) | (c > 15 * m["n_words"]))),
        Rule("repeated_lines", lambda m: _bound(m["lines"], lambda x: 10 * x["dup"] > 5 * x["n"])),
        Rule("words_without_letters", lambda m: 10 * m["lettered"] < 7 * m["n_words"]),
        Rule("mostly_capitals", lambda m: m["capitals"] > m["small"]),
        Rule("ellipses", lambda m: 10 * m["dotted"] > 3 * m["n_words"]),
    ]


def rated(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """Each rule with its share of rejections and its seconds over a small table with ``_t`` and ``_w``.

    One job counts all rejections. A rule's cost is the best of TIMES runs over
    the table as one partition, less the best run of a rule that looks at nothing,
    so that neither the start of a job nor its code's compilation counts.
    """
    m = definitions()
    held = sample.coalesce(1).cache()
    try:
        rows, *hits = held.agg(F.count("*"), *[F.count_if(r.rejects(m)) for r in rules]).first()

        def seconds(rejects: Column) -> float:
            best = float("inf")
            for _ in range(TIMES):
                began = time.perf_counter()
                held.agg(F.count_if(rejects)).first()
                best = min(best, time.perf_counter() - began)
            return best

        nothing = seconds(F.col("_t").isNull())
        return [(r, n / max(1, rows), max(seconds(r.rejects(m)) - nothing, 1e-4)) for r, n in zip(rules, hits, strict=True)]
    finally:
        held.unpersist()


def ordered(found: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by rejections per second, most first; of those that reject nothing the cheapest first; ties keep the given order."""
    return [r for r, _, _ in sorted(found, key=lambda x: (-x[1] / x[2], x[2]))]


def _sampled(docs: DataFrame, text: str, rules: list[Rule]) -> list[Rule]:
    """The rules in the order that a random sample of about SAMPLE_ROWS rows, taken where the rows are, suggests."""
    if len(rules) < 2:
        return rules
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    return ordered(rated(_split(docs.sample(share, 11), text).select("_t", "_w"), rules))


def _verdict(rules: list[Rule], m: Measures) -> Column:
    stop = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        stop = stop.when(rule.rejects(m), F.lit(False))
    return stop.otherwise(F.lit(True))


def cascade(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``_row`` (the input row) and kept of each document, by the base rules and the given ones.

    docs: any table with the text column.
    """
    rules = _sampled(docs, text, base_rules() + (default_rules() if rules is None else rules))
    table = _once(_split(docs, text), n_words=definitions()["n_words"])
    return table.withColumn("kept", _verdict(rules, definitions() | {"n_words": F.col("n_words")})).select("_row", "kept")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, measures, base_failed and kept. Every measure is made, so the rest alone is a cascade."""
    m = definitions()
    rules = _sampled(docs, text, default_rules())
    table = _once(_split(docs, text), **{n: m[n] for n in _REPORTED})
    m |= {n: F.col(n) for n in _REPORTED}
    failed = F.lit(False)
    for rule in base_rules():
        failed = failed | rule.rejects(m)
    table = table.withColumn("base_failed", failed)
    kept = _verdict([Rule("base", lambda _: F.col("base_failed")), *rules], m)
    return table.select(F.col(f"_row.`{doc_id}`").alias("doc_id"), "n_words", "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words", "base_failed", kept.alias("kept"))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the cascade keeps, with the columns they came with."""
    return cascade(docs, text).where("kept").select("_row.*")
