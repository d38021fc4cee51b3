"""Model inference behind small protocols, with deterministic offline defaults.

Models are made once a worker and kept (``cached``); batches that do not fit
are halved and tried again (``in_batches``).
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


class _Places(dict):
    """Twice the place of a word's hash, and one more where its sign is positive; worked out once a word."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        self[word] = place = 2 * (h % self.dim) + (h >> 31)
        return place


class HashingEmbedder:
    """Signed word hashes, scaled to unit length; a text without words is zero."""

    #: Words whose places are kept.
    most = 1 << 17

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.places = _Places(dim)

    def encode(self, texts: list[str]) -> np.ndarray:
        return self.scaled(self.counts(texts))

    def counts(self, texts: list[str]) -> np.ndarray:
        """The vectors before they are scaled: whole numbers, which add up where texts without a common word are joined."""
        if len(self.places) > self.most:
            self.places.clear()
        found: list[int] = []
        counts = []
        for t in texts:
            words = re.findall(r"\w+", t.lower())
            counts.append(len(words))
            found += map(self.places.__getitem__, words)
        at = np.array(found, np.int64)
        cells = np.repeat(np.arange(len(texts)), counts) * self.dim + at // 2
        return np.bincount(cells, 2.0 * (at % 2) - 1, len(texts) * self.dim).reshape(len(texts), self.dim).astype(np.float32)

    def scaled(self, out: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


class Remembering:
    """A model whose vectors are kept by text, for as long as this object is."""

    def __init__(self, model: Embedder):
        self.model, self.known = model, {}

    def encode(self, texts: list[str]) -> np.ndarray:
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        if new:
            self.known.update(zip(new, self.model.encode(new), strict=True))
        return np.stack([self.known[t] for t in texts])


_models: dict[Any, Any] = {}


def cached(key: Any, make: Callable[[], Any], most: int = 4) -> Any:
    """A worker's model for a key; the one not asked for longest goes when there are too many (UD-11)."""
    if key in _models:
        _models[key] = _models.pop(key)
        return _models[key]
    while len(_models) >= most:
        _models.pop(next(iter(_models)))
    _models[key] = make()
    return _models[key]


def clear_models() -> None:
    _models.clear()


def in_batches(f: Callable[[list], Any], items: list, size: int = 32) -> list:
    """f over batches; a batch that runs out of memory is halved, down to one (UD-3)."""
    out, at = [], 0
    while at < len(items):
        try:
            out.extend(f(items[at : at + size]))
            at += size
        except (MemoryError, RuntimeError) as e:
            if size == 1 or (isinstance(e, RuntimeError) and "out of memory" not in str(e).lower()):
                raise
            size //= 2
    return out


def retried(f: Callable[[], str], tries: int = 3, pause: float = 0.0) -> str:
    """RuntimeError after so many failures (UD-9)."""
    last: Exception | None = None
    for _ in range(tries):
        try:
            return f()
        except Exception as e:  # whatever a client raises
            last = e
            time.sleep(pause)
    raise RuntimeError(f"failed {tries} times") from last


def embedded(df: DataFrame, text: str, make: Callable[[], Embedder] = HashingEmbedder, name: str = "embedding", batch: int = 32) -> DataFrame:
    """The table with a float vector for each text (UD-1, UD-2, UD-4)."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = cached((make, "embedder"), make)
        for p in parts:
            yield pd.Series(in_batches(lambda x: list(model.encode(x)), p.fillna("").tolist(), batch))

    return df.withColumn(name, run(F.col(text)))


def overlap_score(query: Column, text: Column) -> Column:
    """The share of a query's distinct words that a text has: the offline stand-in for a cross-encoder (UD-5)."""
    w = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    return F.coalesce(F.size(F.array_intersect(w(query), w(text))) / F.nullif(F.size(w(query)), F.lit(0)), F.lit(0.0))


class OverlapScorer:
    """``overlap_score`` as a model: the share of a query's distinct words that a text has."""

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        words = lambda s: set(re.findall(r"[^\W_]+", s.lower()))
        asked = [(words(q), words(t)) for q, t in pairs]
        return np.array([len(q & t) / len(q) if q else 0.0 for q, t in asked], np.float64)


def pair_scored(df: DataFrame, query: str, text: str, make: Callable[[], PairScorer] = OverlapScorer, name: str = "score", batch: int = 32) -> DataFrame:
    """The table with a model's score for each query and text; nulls are empty (UD-5)."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = cached((make, "scorer"), make)
        for q, t in parts:
            pairs = list(zip(q.fillna(""), t.fillna(""), strict=True))
            yield pd.Series(in_batches(lambda x: model.score(x).tolist(), pairs, batch), dtype="float64")

    return df.withColumn(name, run(F.col(query), F.col(text)))


def generated(df: DataFrame, system: str, user: str, generate: Callable[[str, str], str | None], name: str = "raw", tries: int = 2) -> DataFrame:
    """The table with a model's reply (UD-6); a null reply is asked for once more, then empty."""

    @F.pandas_udf("string")
    def run(s: pd.Series, u: pd.Series) -> pd.Series:
        def ask(a: str, b: str) -> str:
            reply = retried(lambda: generate(a, b), tries)  # type: ignore[arg-type,return-value]
            return (generate(a, b) or "") if reply is None else reply

        return pd.Series([ask(a, b) for a, b in zip(s, u, strict=True)])

    return df.withColumn(name, run(F.col(system), F.col(user)))


def first_option(system: str, user: str) -> str:
    """A deterministic stand-in for a model: the first option, or the first words of the context."""
    if "<letter>" in system:
        return "Answer: A"
    return "Answer: " + " ".join(user.partition("Context:\n")[2].split()[1:6])


def exact_judge(system: str, user: str) -> str:
    """A deterministic stand-in for a judge: correct if a reference answer occurs in the candidate."""
    gold = user.partition("Reference answers:\n")[2].partition("\n\nCandidate")[0].split("\n")
    said = user.partition("Candidate answer:\n")[2].lower()
    return "Verdict: " + ("correct" if any(g and g.lower() in said for g in gold) else "incorrect")
