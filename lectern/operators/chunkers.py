"""Text segmentation: chunkers over whole books, parallel by book.

A chunker takes a text and parameters and returns spans (start, end), half
open. ``chunked`` trims them, makes the end inclusive and drops blank ones, so
``text[start_index : end_index + 1]`` is always the chunk's text. Strides and
token windows are also there as pure expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.models import Embedder, HashingEmbedder, Remembering, cached
from lectern.registry import chunkers

Span = tuple[int, int]
#: Fixed value: the pattern of one sentence.
SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*")
_TOKEN = re.compile(r"[^\W_]+|_+|[^\w\s]")
#: Characters of the texts whose chunks a task holds at once.
CHUNKED_BYTES = 1 << 20


def sentences(text: str) -> list[Span]:
    """Sentences by their match positions (CH-10, CH-11)."""
    return [m.span() for m in SENTENCE.finditer(text)]


def tight_sentences(text: str) -> list[Span]:
    """Sentences without the blanks around them, where a trained tokenizer would be used (CH-12)."""
    out = []
    for a, b in sentences(text):
        s = text[a:b]
        if s.strip():
            out.append((a + len(s) - len(s.lstrip()), b - (len(s) - len(s.rstrip()))))
    return out


def _model(name: str | None):
    return cached(("embedder", name), HashingEmbedder)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@chunkers.register("fixed_size")
def fixed_size(text: str, chunk_size: int, overlap: int = 0, mode: str = "char") -> list[Span]:
    """Sentences (mode char) or tokens (mode token) up to a size, with an overlap (CH-1, CH-2)."""
    chunk_size, overlap = int(chunk_size), int(overlap)
    _need(overlap < chunk_size, "the overlap must be smaller than the chunk")
    if mode == "token":
        toks = [m.span() for m in _TOKEN.finditer(text)]
        out = []
        for i in range(0, len(toks), chunk_size - overlap):
            part = toks[i : i + chunk_size]
            out.append((part[0][0], part[-1][1]))
            if i + chunk_size >= len(toks):
                break
        return out
    _need(mode == "char", f"no mode {mode!r}")
    s, out, i = sentences(text), [], 0
    while i < len(s):
        j = i + 1
        while j < len(s) and s[j][1] - s[i][0] <= chunk_size:
            j += 1
        out.append((s[i][0], s[j - 1][1]))
        if j >= len(s):
            break
        k = j
        while k - 1 > i and s[j - 1][1] - s[k - 1][0] <= overlap:
            k -= 1
        i = k
    return out


_LEVELS = (r"\n\s*\n", r"\n", r"(?<=[.!?])\s", r"[,;:]\s", r"\s")


def _split_at(text: str, span: Span, level: int) -> list[Span]:
    at, out = span[0], []
    for m in re.finditer(_LEVELS[level], text[span[0] : span[1]]):
        end = span[0] + m.end()
        if end > at:
            out.append((at, end))
            at = end
    return out + [(at, span[1])] if at < span[1] else out


def _merged(spans: list[Span], size: int) -> list[Span]:
    """Neighbours joined while they fit."""
    out: list[Span] = []
    for a, b in spans:
        if out and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@chunkers.register("recursive")
def recursive(text: str, chunk_size: int, min_characters_per_chunk: int = 24) -> list[Span]:
    """Paragraphs, lines, sentences, clauses, words, then plain cuts, until pieces fit (CH-3)."""
    size, least = int(chunk_size), int(min_characters_per_chunk)
    _need(least < size, "the least size must be smaller than the chunk")

    def cut(span: Span, level: int) -> list[Span]:
        if span[1] - span[0] <= size:
            return [span]
        if level == len(_LEVELS):
            return [(a, min(a + size, span[1])) for a in range(span[0], span[1], size)]
        return _merged([x for p in _split_at(text, span, level) for x in cut(p, level + 1)], size)

    out: list[Span] = []
    for a, b in cut((0, len(text)), 0) if text else []:
        if out and b - a < least and b - out[-1][0] <= size:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _smooth(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """A least-squares polynomial over a sliding window, read at its middle."""
    if len(x) < window or window <= order:
        return x
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    weights = np.linalg.pinv(basis)[0]
    wide = np.pad(x, half, mode="edge")
    return np.array([weights @ wide[i : i + window] for i in range(len(x))])


def _likeness(v: np.ndarray, window: int) -> np.ndarray:
    """Of each vector but the first, to the mean of those before it within a window."""
    n = len(v)
    means = [v[:i].mean(0) for i in range(1, min(window, n))]
    if n > window:
        total = v[: n - window].copy()
        for t in range(1, window):
            total += v[t : n - window + t]
        means.extend(total / np.float32(window))
    return np.array([float(a @ b) for a, b in zip(v[1:], means, strict=True)])


@chunkers.register("semantic")
def semantic(text: str, threshold: float = 0.5, chunk_size: int = 512, similarity_window: int = 3, filter_window: int = 5, filter_polyorder: int = 2, embedding_model: str | None = None, skip_window: int = 0) -> list[Span]:
    """Cuts where the smoothed likeness to the sentences before has a low below the threshold (CH-4)."""
    return _semantic(text, _model(embedding_model), threshold, chunk_size, similarity_window, filter_window, filter_polyorder, skip_window)


def _semantic(text: str, model: Embedder, threshold: float, chunk_size: int, similarity_window: int = 3, filter_window: int = 5, filter_polyorder: int = 2, skip_window: int = 0) -> list[Span]:
    s = sentences(text)
    if len(s) < 2:
        return s
    v = model.encode([text[a:b] for a, b in s])
    like = _likeness(v, similarity_window)
    like = _smooth(like, filter_window, filter_polyorder)
    cuts = [i + 1 for i in range(len(like)) if like[i] < threshold and (i == 0 or like[i] <= like[i - 1]) and (i + 1 == len(like) or like[i] <= like[i + 1])]
    groups = [(a, b) for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True) if a < b]
    if skip_window:  # groups that turn back to what stood before are joined again
        kept = [groups[0]]
        for g in groups[1:]:
            back = v[kept[-1][0] : kept[-1][1]].mean(0) @ v[g[0] : g[1]].mean(0)
            if back >= threshold:
                kept[-1] = (kept[-1][0], g[1])
            else:
                kept.append(g)
        groups = kept
    out = []
    for a, b in groups:
        tokens, first = 0, a
        for i in range(a, b):
            n = len(_TOKEN.findall(text[s[i][0] : s[i][1]]))
            if i > first and tokens + n > int(chunk_size):
                out.append((s[first][0], s[i - 1][1]))
                first, tokens = i, 0
            tokens += n
        out.append((s[first][0], s[b - 1][1]))
    return out


@chunkers.register("neural")
def neural(text: str, split: Callable[[str], list[Span]] | None = None, min_characters_per_chunk: int = 10, **_: object) -> list[Span]:
    """A model's cuts, or the whole text where there is none or it fails (CH-5)."""
    if split is None:
        return [(0, len(text))]
    try:
        return [(a, b) for a, b in split(text) if text[a:b].strip() and b - a >= min_characters_per_chunk] or [(0, len(text))]
    except Exception:  # whatever a model raises
        return [(0, len(text))]


def _size_factor(n: int) -> float:
    return 1 / (1 + np.exp(-n)) if n <= 20 else float(np.log1p(np.exp(0.5 * (n - 20))) / np.log(2))


@chunkers.register("max_min")
def max_min(text: str, hard_threshold: float = 0.6, c_param: float = 0.9, init_const: float = 1.5, model_name: str | None = None) -> list[Span]:
    """A sentence joins the running group if its best likeness beats a threshold that grows with the group (CH-7)."""
    s = tight_sentences(text)
    if not s:
        return []
    v = _model(model_name).encode([text[a:b] for a, b in s]).astype(float)
    out, first, least = [], 0, np.inf
    for i in range(1, len(s)):
        likes = v[first:i] @ v[i]
        if i - first == 1:
            least = float(likes[0])
            best, bar = init_const * least, 0.0
        else:
            bar = max(0.0, least * c_param * _size_factor(i - first - 1))
            best = float(likes.max())
            least = min(least, float(likes.min()))
        if best <= max(bar, hard_threshold):
            out.append((s[first][0], s[i - 1][1]))
            first, least = i, np.inf
    return out + [(s[first][0], s[-1][1])]


@chunkers.register("sequential_hac")
def sequential_hac(text: str, distance_threshold: float | None = None, avg_chunk_size: int | None = None, linkage: str = "single", model_name: str | None = None, batch_size: int = 32) -> list[Span]:
    """Single linkage along the chain of sentences: cuts at the widest gaps, by threshold or by number (CH-8)."""
    _need(linkage == "single", "linkage along a chain is there as single")
    s = tight_sentences(text)
    if len(s) < 2:
        return s
    v = _model(model_name).encode([text[a:b] for a, b in s]).astype(float)
    gaps = 1 - (v[:-1] * v[1:]).sum(1)
    if distance_threshold is not None:
        cuts = [i + 1 for i, g in enumerate(gaps) if g >= float(distance_threshold)]
    else:
        n = max(1, min(len(s), len(_TOKEN.findall(text)) // int(avg_chunk_size or 1)))
        cuts = sorted(int(i) + 1 for i in np.argsort(-gaps, kind="stable")[: n - 1])
    return [(s[a][0], s[b - 1][1]) for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]


@chunkers.register("packed_sentences")
def packed_sentences(text: str, most: int) -> list[Span]:
    """Sentences packed up to a size; longer ones are cut into pieces of that size (CH-13)."""
    out: list[Span] = []
    for a, b in sentences(text) if len(text) > most else [(0, len(text))]:
        if b - a > most:
            out += [(x, min(x + most, b)) for x in range(a, b, most)]
        elif out and out[-1][1] == a and b - out[-1][0] <= most and out[-1][1] - out[-1][0] < most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@chunkers.register("recursive_semantic")
def recursive_semantic(text: str, max_chunk_size: int = 20000, recursive_threshold: int = 1000, final_threshold: int = 1200, merge_threshold: int = 200, delta: int = 100, threshold: float = 0.5, embedding_model: str | None = None) -> list[Span]:
    """Segments, semantic cuts, finer cuts of what is too long, merging of what is short, a last cap (CH-6)."""
    _need(0 < delta < recursive_threshold <= max_chunk_size, "sizes must descend and delta be smaller")
    _need(merge_threshold < final_threshold, "the merge size must be smaller than the final one")
    model = Remembering(_model(embedding_model))  # the same sentences come back at every finer size

    def finer(span: Span, size: int) -> list[Span]:
        if span[1] - span[0] <= size:
            return [span]
        size = max(size - delta, 1)
        parts = [(span[0] + a, span[0] + b) for a, b in _semantic(text[span[0] : span[1]], model, threshold, size // 4 or 1)]
        if len(parts) < 2:
            return [span]
        return [x for p in parts for x in finer(p, size)]

    def joined(spans: list[Span]) -> list[Span]:
        spans, i = list(spans), 0
        # A growing span isn't embedded anew where the counts of its parts add up: spans meet at the ends of sentences,
        # and only the lower case of a final sigma depends on what comes after.
        adds = hasattr(model.model, "counts") and "\u03a3" not in text
        counts = list(model.model.counts([text[x:y] for x, y in spans])) if adds else []
        while i < len(spans):
            a, b = spans[i]
            if b - a > merge_threshold or len(spans) == 1:
                i += 1
                continue
            before, after = i > 0, i + 1 < len(spans)
            if before and after:
                v = model.model.scaled(np.stack(counts[i - 1 : i + 2])) if adds else model.encode([text[x:y] for x, y in spans[i - 1 : i + 2]])
                before = float(v[1] @ v[0]) >= float(v[1] @ v[2])
            if before:
                i -= 1
            spans[i : i + 2] = [(spans[i][0], spans[i + 1][1])]
            if adds:
                counts[i : i + 2] = [counts[i] + counts[i + 1]]
        return spans

    out: list[Span] = []
    for segment in packed_sentences(text, max_chunk_size):
        model.known.clear()
        first = [(segment[0] + a, segment[0] + b) for a, b in _semantic(text[segment[0] : segment[1]], model, threshold, recursive_threshold // 4 or 1)]
        out += joined([x for p in first for x in finer(p, recursive_threshold)])
    return [(a + x, a + y) for a, b in out for x, y in (recursive(text[a:b], final_threshold, 1) if b - a > final_threshold else [(0, b - a)])]


@chunkers.register("lumber")
def lumber(text: str, pick: Callable[[str, int, int], str] | None = None, group_size_threshold: int = 550, max_retries: int = 3, **_: object) -> list[Span]:
    """A model names the sentence at which a growing group turns to something new (CH-9).

    pick(block, first id, last id) returns the model's reply; the stand-in names the last.
    """
    _need(group_size_threshold > 0, "the group size must be positive")
    _need(max_retries > 0, "the number of tries must be positive")
    ask = pick or (lambda block, first, last: f"Answer: ID {last}")
    s = tight_sentences(text)
    n, at, bounds = len(s), 0, []
    words = [len(text[a:b].split()) + 2 for a, b in s]  # and the two of its id
    for _turn in range(n):
        if at >= n - 5:
            break
        size, total = 0, 0
        # Fixed value: tokens a word. The whole block is rounded, not each sentence.
        while round(1.2 * total) < group_size_threshold and at + size < n - 1:
            total += words[at + size]
            size += 1
        last = at + max(size - 1, 1) - 1
        block = "\n".join(f"ID {k}: {text[s[k][0] : s[k][1]]}" for k in range(at, last + 1))
        reply = ""
        for _try in range(max_retries):
            try:
                reply = ask(block, at, last)
                break
            except Exception:  # whatever a client raises
                continue
        found = re.search(r"Answer:\s*ID\s*(\d+)", reply) or re.search(r"\bID\s+(\d+)\b", reply)
        if found is None:
            at = at + max(size, 1)
        elif int(found[1]) < at:
            at += 1
        else:
            bounds.append(min(int(found[1]), n - 1))
            at = bounds[-1] + 1
    ends = [*bounds, n]
    return [(s[a][0], s[b - 1][1]) for a, b in zip([0, *ends], ends, strict=False) if a < b]


def spans_of(text: str, method: str, **params: object) -> list[tuple[str, int, int]]:
    """Chunks of a text: trimmed text, start and inclusive end."""
    out = []
    for a, b in chunkers.get(method)(text, **params):
        s = text[a:b]
        left = len(s) - len(s.lstrip())
        if s := s.strip():
            out.append((s, a + left, a + left + len(s) - 1))
    return out


def chunk_batches(method: str, given: dict[str, object], book: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of book and text to batches of chunks, each of a few texts however many came at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0

            def table(b: pa.RecordBatch, rows: list) -> pa.RecordBatch:
                at, *columns = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [book, "chunk_no", "start_index", "end_index", "tokens_len", "text"])

            for r in range(len(b)):
                # One text at a time, and chunks of a few bytes: a batch may have very many rows.
                if t := b.column(1)[r].as_py():
                    rows += [(r, i, x, y, len(_TOKEN.findall(s)), s) for i, (s, x, y) in enumerate(spans_of(t, method, **given))]
                    size += len(t)
                if rows and (size > CHUNKED_BYTES or len(rows) > 10_000):
                    yield table(b, rows)
                    rows, size = [], 0
            if rows:
                yield table(b, rows)

    return run


def chunked(books: DataFrame, method: str, params: dict[str, object] | None = None, book: str = "source_file", text: str = "text") -> DataFrame:
    """book, chunk_no, start_index, end_index (inclusive), tokens_len, text and method of every chunk (CH-14)."""
    chunkers.get(method)  # an unknown name fails here, not in a task
    given = dict(params or {})

    kind = books.schema[book].dataType.simpleString()
    return books.select(book, text).mapInArrow(chunk_batches(method, given, book), f"{book} {kind}, chunk_no int, start_index int, end_index int, tokens_len int, text string").withColumn("method", F.lit(method))


def missing_splits(wanted: str, present: set[str]) -> list[str]:
    """The splits still to do; ``all`` stands for all three (CH-15)."""
    return [s for s in (("train", "validation", "test") if wanted == "all" else (wanted,)) if s not in present]


def strides(books: DataFrame, size: int, overlap: int, book: str, text: str = "text") -> DataFrame:
    """Plain character windows, as expressions alone."""
    _need(0 <= overlap < size, "the overlap must be smaller than the chunk")
    step = size - overlap
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)))
    rows = books.select(book, F.col(text).alias("_t"), at.alias("start_index"))
    return rows.select(book, "start_index", (F.least(F.col("start_index") + size, F.length("_t")) - 1).alias("end_index"), F.substring(F.col("_t"), F.col("start_index") + 1, F.lit(size)).alias("text"))


def token_windows(books: DataFrame, size: int, overlap: int, book: str, text: str = "text") -> DataFrame:
    """Windows over word tokens, as expressions alone: book, first token, tokens_len and text joined by blanks."""
    _need(0 <= overlap < size, "the overlap must be smaller than the chunk")
    step = size - overlap
    rows = books.select(book, F.filter(F.split(text, r"[ \n\t]+"), lambda x: x != "").alias("_w"))
    last = F.greatest(F.ceil((F.size("_w") - size) / step).cast("int"), F.lit(0))
    rows = rows.where(F.size("_w") > 0).select(book, "_w", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    part = F.slice("_w", F.col("_i") * step + 1, F.lit(size))
    return rows.select(book, (F.col("_i") * step).alias("first_token"), F.size(part).alias("tokens_len"), F.array_join(part, " ").alias("text"))


def hac_runs(sents: DataFrame, threshold: float, book: str, pos: str, vector: str) -> DataFrame:
    """Single-linkage chain clustering over embedded sentences as a window: book, group_no, first and last position (CH-8, WN-7)."""
    from lectern.functions.vector import cosine, doubles

    w = Window.partitionBy(book).orderBy(pos)
    v = doubles(F.col(vector))
    gap = F.round(1 - cosine(v, F.lag(v).over(w)), 9)
    cut = F.when(F.lag(v).over(w).isNotNull() & (gap >= threshold), 1).otherwise(0)
    runs = sents.withColumn("_cut", cut).withColumn("group_no", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(book, "group_no").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count("*").alias("n"))
