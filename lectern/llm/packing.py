"""Packing of token ids into sequences by cutting-stock column generation.

Documents longer than a sequence are cut into full pieces and a rest. The
lengths of the pieces form a histogram of at most ``capacity / unit`` bins,
whatever the size of the corpus. A linear program over patterns (multisets of
bins that fill a sequence) covers the histogram with the fewest sequences;
knapsack dynamic programming prices new patterns from its duals. Patterns are
used a whole number of times, what rounding leaves is packed first fit, and
pieces, ranked within their bin, take the places that the patterns hold.

Only the histogram reaches the driver. Ranks come from two levels (counts by
bin and salt, then row numbers within both), so one common length never meets
in one task.

Defined results: a null text is empty and has the end id alone; repeated rows
are packed as often as they come; ties in length are ranked by id and start;
an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import shuffle_width, stored
from lectern.llm.tokens import encoder

CAPACITY, END_ID = 2048, 1
#: Lengths are binned upwards to multiples of this many ids for the linear program.
UNIT = 8
#: The program ends within this share of its optimum (Farley's bound: the objective over the best price), or after so many pivots.
TOLERANCE, PIVOTS = 1e-3, 6000


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece; the ids too, if asked for."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                which, start, length, crc, total, ids = [], [], [], [], [], []
                for k, t in enumerate(part.column(1)):
                    raw = tool.encode(t.as_py()) + end
                    n = len(raw) // 4
                    for s in range(0, n, capacity):
                        piece = raw[4 * s : 4 * (s + capacity)]
                        which.append(k), start.append(s), length.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
                        if with_ids:
                            ids.append(piece)
                columns = [part.column(0).take(pa.array(which, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids binary" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long{more}")


def priced(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of bins with the most value within the room (unbounded knapsack), as counts by bin."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1, np.int64)
    useful = np.flatnonzero(values > 1e-12)
    value, size = values[useful], sizes[useful]
    for c in range(1, room + 1):
        best[c], take[c] = best[c - 1], -1
        fit = np.searchsorted(size, c, side="right")
        if fit:
            gain = best[c - size[:fit]] + value[:fit]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], take[c] = gain[k], k
    counts, c = np.zeros(len(values), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[useful[take[c]]] += 1
            c -= size[take[c]]
    return float(best[room]), counts


def solved(sizes: np.ndarray, demand: np.ndarray, room: int, pivots: int = PIVOTS) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses them, by the revised simplex method with priced columns.

    sizes: ascending bin sizes; demand: pieces of each bin.
    """
    m = len(sizes)
    columns = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    # einsum rather than BLAS, whose threads may hang in a process that drives a JVM.
    times = lambda a, b: np.einsum("ij,j...->i...", a, b)
    used = times(inverse, demand)
    for step in range(pivots):
        duals = inverse.sum(0)
        worth, pattern = priced(duals, sizes, room)
        if worth <= 1 + TOLERANCE:
            break
        way = times(inverse, pattern)
        ok = way > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = used[ok] / way[ok]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = pattern
        if step % 200 == 199:  # keeps rounding errors from adding up
            inverse = 2 * inverse - times(times(inverse, columns), inverse)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
        used = np.maximum(times(inverse, demand), 0)
    return [(columns[:, k].astype(np.int64), float(used[k])) for k in range(m) if used[k] > 1e-9]


def plan(histogram: dict[int, int], room: int) -> list[tuple[Counter, int]]:
    """Patterns (counts by bin size) and whole uses that hold exactly the pieces of the histogram."""
    left = Counter({s: n for s, n in histogram.items() if n})
    out: list[tuple[Counter, int]] = []
    if not left:
        return out
    sizes = np.array(sorted(left))
    demand = np.array([left[s] for s in sizes.tolist()], float)
    # Whole uses first, then once more each pattern whose pieces are still there, the larger fractions first.
    found = sorted(solved(sizes, demand, room), key=lambda x: -x[1])
    once = sorted((x for x in found), key=lambda x: -(x[1] % 1))
    for pattern, uses in [*found, *((p, 1.0) for p, _ in once)]:
        items = Counter({int(s): int(n) for s, n in zip(sizes, pattern, strict=True) if n})
        times = min(int(uses + 1e-6), *(left[s] // n for s, n in items.items()))
        if times > 0:
            out.append((items, times))
            for s, n in items.items():
                left[s] -= n * times
    # What is left is less than one use of each pattern: largest first, each sequence filled in turn.
    while left := +left:
        space, items = room, Counter()
        for s in sorted(left, reverse=True):
            n = min(left[s], space // s)
            if n:
                items[s] += n
                space -= n * s
        times = min(left[s] // n for s, n in items.items())
        out.append((items, times))
        left.subtract({s: n * times for s, n in items.items()})
    return out


def packed(found: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """The pieces with sequence_id and offset. found: the columns of ``pieces``."""
    spark = found.sparkSession
    names = found.columns
    found = stored(found, "pieces")
    salts = shuffle_width(spark)
    binned = found.withColumn("_bin", F.ceil(F.col("length") / unit).cast("int")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    by_bin = {r[0]: r[1] for r in binned.groupBy("_bin").count().collect()}  # at most capacity / unit rows
    slots, sequences, first = [], 0, Counter()
    for items, times in plan(by_bin, capacity // unit):
        place = 0
        for size, n in sorted(items.items(), reverse=True):
            slots.append((size, first[size], first[size] + n * times, sequences, n, place))
            first[size] += n * times
            place += n
        sequences += times
    # Patterns number at most a few for each bin, so this table has a bound that the corpus doesn't move.
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], "_bin int, _from long, _to long, _base long, _n long, _place long")
    counts = stored(binned.groupBy("_bin", "_salt").agg(F.count("*").alias("_many")), "counts")
    before = F.sum("_many").over(Window.partitionBy("_bin").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("_bin", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_bin", "_salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = binned.withColumn("_local", local).join(before, ["_bin", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    at = F.col("_rank") - F.col("_from")
    placed = ranked.join(F.broadcast(table), "_bin").where("_rank >= _from and _rank < _to")
    placed = placed.withColumn("sequence_id", F.col("_base") + F.floor(at / F.col("_n"))).withColumn("_slot", F.col("_place") + at % F.col("_n"))
    so_far = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*names, "sequence_id", F.coalesce(F.sum("length").over(so_far), F.lit(0)).cast("long").alias("offset"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All documents as pieces in sequences of at most ``capacity`` ids."""
    return packed(pieces(docs, path, capacity, end_id, with_ids), capacity)
