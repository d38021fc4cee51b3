"""A factorisation machine that scores the quality of texts.

Features: hashed words (lower-cased, with their share of the text), structure
statistics and metadata of the text in bins (its length, the share of
capitals, symbols, repeated words, repeated lines and so on). The pairwise
part is ``0.5 * sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``, so a text is
scored in time linear in its features.

Learning takes at most ``train_rows`` labelled rows and ``train_words`` of their
words (documented bounds: the fit runs on the driver and costs the same at
every size); scoring covers all rows and all of each text, however long, in
Arrow batches on the executors.

Defined results: null and empty texts are scored by their structure alone;
repeated rows get equal scores; an empty table gives an empty result; labels
that are null are left out; without labels of both kinds every score is the
share of label 1 (0.5 without any). Columns of the input other than the id and
the text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import Tables, held_out, words

TRAIN_ROWS = 6000
#: Word features of the rows to learn from (four bytes each) that reach the driver; rows beyond go, the last by hashed id first.
TRAIN_WORDS = 8_000_000
BUCKETS, RANK, EPOCHS, THRESHOLD = 1 << 14, 4, 12, 0.3
#: Bins of one structure statistic.
_BINS = 12
_STATS = ("words", "lines", "mean_word", "symbols", "capitals", "digits", "letters", "repeated_words", "repeated_lines", "repeated_pairs", "marks", "stops")
_WIDTH = BUCKETS + len(_STATS) * _BINS


def features(docs: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    """doc_id, word buckets (array<int>) and the structure statistics (array<double>) of each text, all by built-in functions.

    Word pairs are hashed too, only to count how many repeat.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("t"), words(t).alias("w"), *more)
    n = F.size("w")
    base = base.select(
        "doc_id", "t", *more,
        F.transform("w", lambda x: F.pmod(F.xxhash64(F.lower(x)), F.lit(BUCKETS)).cast("int")).alias("ids"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("lines"),
    )
    pairs = F.when(F.size("h") >= 2, F.transform(F.sequence(F.lit(0), F.size("h") - 2), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("pairs", pairs)
    n, chars = F.greatest(F.size("h"), F.lit(1)), F.greatest(F.length("t"), F.lit(1))
    left = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    share = lambda x, y: (x / y).cast("double")
    lines = F.greatest(F.size("lines"), F.lit(1))
    stats = F.array(
        (F.log2(F.size("h") + F.lit(1.0)) / 16).cast("double"),
        (F.log2(F.size("lines") + F.lit(1.0)) / 12).cast("double"),
        share(F.length(F.translate("t", " \t\n\x0b\x0c\r", "")), 20 * n),
        share(F.length("t") - F.length(F.translate("t", "#*$%&|<>", "")), 2 * n),
        share(left(r"\p{Lu}+"), chars),
        share(4 * left(r"\d+"), chars),
        share(left(r"\p{L}+"), chars),
        share(n - F.size(F.array_distinct("h")), n),
        share(lines - F.size(F.array_distinct("lines")), lines),
        share(F.size("pairs") - F.size(F.array_distinct("pairs")), n),
        share(F.length("t") - F.length(F.translate("t", "!?", "")), n),
        share(F.length("t") - F.length(F.translate("t", ".,;:", "")), n),
    )
    return base.select("doc_id", *more, "ids", stats.alias("stats"))


def _sparse(ids: pa.Array, stats: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all features of a batch, rows in order, no feature twice in a row."""
    rows = len(ids)
    ends = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] if rows else np.zeros(0, np.int32)
    counts = np.diff(ends)
    key = np.repeat(np.arange(rows, dtype=np.int64), counts) * _WIDTH + flat
    key, n = np.unique(key, return_counts=True)
    row = key // _WIDTH
    value = n / np.sqrt(np.bincount(row, n.astype(float) ** 2, rows))[row]
    s = stats.flatten().to_numpy(zero_copy_only=False).reshape(rows, len(_STATS))
    binned = np.clip(np.nan_to_num(np.ceil(np.sqrt(np.clip(s, 0, 1)) * (_BINS - 1))), 0, _BINS - 1).astype(np.int64)
    binned += BUCKETS + np.arange(len(_STATS)) * _BINS
    row = np.concatenate([row, np.repeat(np.arange(rows), len(_STATS))])
    feature = np.concatenate([key % _WIDTH, binned.ravel()])
    value = np.concatenate([value, np.full(binned.size, 1 / np.sqrt(len(_STATS)))])
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order]


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.full(rows, self.bias) + np.bincount(row, self.linear[feature] * value, rows)
        for f in range(self.factors.shape[1]):
            x = self.factors[feature, f] * value
            out += 0.5 * (np.bincount(row, x, rows) ** 2 - np.bincount(row, x * x, rows))
        return out

    def score(self, rows: int, *x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows, *x), -30, 30)))

    def scores(self, ids: pa.Array, stats: pa.Array, at_once: int = 512) -> np.ndarray:
        """The scores of a batch, a few rows at a time."""
        parts = [self.score(min(at_once, len(ids) - k), *_sparse(ids.slice(k, at_once), stats.slice(k, at_once))) for k in range(0, len(ids), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0)


def fit(sample: pa.Table, epochs: int = EPOCHS, rank: int = RANK, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Learn from columns ids, stats and label by Adam on mini-batches of logistic loss."""
    table = sample.combine_chunks()
    y = table["label"].to_numpy().astype(float)
    share = float(y.mean()) if len(y) else 0.5
    linear, rng = np.zeros(_WIDTH), np.random.default_rng(seed)
    factors = rng.normal(0, 0.05, (_WIDTH, rank))
    if not len(y):
        return Machine(0.0, linear, factors * 0)
    if not 0 < share < 1:
        return Machine(float(np.log((share + 1e-3) / (1 - share + 1e-3))), linear, factors * 0)
    ids, stats = table["ids"].combine_chunks(), table["stats"].combine_chunks()
    row, feature, value = _sparse(ids, stats)
    ends = np.searchsorted(row, np.arange(len(y) + 1))
    bias, w = np.array([np.log(share / (1 - share))]), [linear, factors]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (linear, factors)]
    step, size = 0, 256
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            batch, step = order[at : at + size], step + 1
            picks = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in batch])
            r = np.repeat(np.arange(len(batch)), ends[batch + 1] - ends[batch])
            used, f = np.unique(feature[picks], return_inverse=True)
            x = value[picks]
            v = factors[used][f] * x[:, None]
            sums = np.stack([np.bincount(r, v[:, k], len(batch)) for k in range(rank)], 1)
            squares = np.bincount(r, (v * v).sum(1), len(batch))
            m = bias[0] + np.bincount(r, linear[used][f] * x, len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            g = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[batch]) / len(batch)
            bias -= rate * g.sum()
            gx = g[r] * x
            grads = np.bincount(f, gx, len(used)), np.stack([np.bincount(f, gx * (sums[r, k] - v[:, k]), len(used)) for k in range(rank)], 1)
            for p, (m1, m2), grad in zip(w, moments, grads, strict=True):
                grad = grad + decay * p[used]
                m1[used] = 0.9 * m1[used] + 0.1 * grad
                m2[used] = 0.999 * m2[used] + 0.001 * grad * grad
                p[used] -= rate * (m1[used] / (1 - 0.9**step)) / (np.sqrt(m2[used] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(bias[0]), linear, factors)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS, train_words: int = TRAIN_WORDS) -> Machine:
    """Fit on at most ``train_rows`` labelled documents with ``train_words`` words in all, none of them held out.

    Which rows: those whose hashed id is smallest, so that the choice is the
    same however the tables are dealt. A document with several labels counts
    once, with the largest.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(picked), "_id")
    with Tables(docs.sparkSession) as tables:
        found = tables.store(features(rows, "_id", "_text", "label").withColumn("_n", F.size("ids")), "labelled")
        # Few rows, of which the sizes come first, so that what the driver gathers has a bound in bytes as well.
        so_far = F.sum("_n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
        some = found.groupBy("doc_id").agg(F.sum("_n").alias("_n")).withColumn("_sum", so_far).where(F.col("_sum") <= train_words)
        return fit(found.join(F.broadcast(some.select("doc_id")), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select("ids", "stats", "label").toArrow())


def scored(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; whole texts, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(machine.scores(b.column("ids"), b.column("stats")))], ["doc_id", "score"])

    found = features(docs, doc_id, text)
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, score double")


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every document."""
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score from ``threshold`` on, with the columns they came with.

    The score is joined to the row inside the scoring pass, so texts are not shuffled.
    """
    machine = train(docs, labels)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = kept.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = machine.scores(b.column("ids"), b.column("stats")) >= threshold
            for at in range(0, b.num_rows, 1024):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, 1024).filter(pa.array(good[at : at + 1024]))], ["row"])

    rows = features(kept.select("row", F.col("row.text").alias("text")), "row", "text")
    return rows.mapInArrow(run, f"row {schema.simpleString()}").select("row.*")
