"""Near-duplicate detection by min-max hashing, with links confirmed on full sets.

Each hash function gives two signature values, the minimum and the maximum
over a document's shingles, so half the evaluations fill the same bands.
Documents with equal sets are one node before anything else. Buckets then
give few candidates: every member meets the bucket's smallest and largest
node (a star, linear in the bucket). Candidates pass a one-byte sketch
estimate far below the threshold, then the exact test on full sets, which meet
row by row in the JVM; a hub's set is sent once for each bounded block of its
members. Buckets whose members are not yet one component are worked off: small
ones by their pairs, large ones in tiles of bounded size that emit only links
which join components. Nothing is capped, and no group is gathered whole.

Tables between steps are written to the shared folder, so lost executors cost
one step at most; they are deleted when the result is written. Components
spread minima with pointer jumps over joins.

Defined results: null, empty and blank texts have an empty set and are linked
with nothing; with fewer words than a shingle has the sequence is the only
one; whole texts count, whatever their length; rows that repeat a doc_id are
documents of their own, linked by their texts; a null doc_id is linked with
nothing and kept; an empty table gives an empty result; other columns are
never read by ``link_components``, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Tables, ascii_lower, stored, words

#: Production parameters: words a shingle, percent of similarity, bands and rows of a band (two values a hash function).
SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 28, 6
#: A bucket of at most this many is worked off by pairs, a larger one in tiles of about TILE documents a side.
PAIRS_UP_TO, TILE = 12, 256
#: Shingles in a block of a tile (eight bytes each), and members of a bucket to which its hub's set is sent at once.
TILE_SHINGLES, HUB_BLOCK = 1 << 20, 64
#: Six standard deviations of the sketch estimate.
_SLACK = 6
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _sets(hashes: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of word hashes."""
    ends = hashes.offsets.to_numpy()
    flat = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64) if len(hashes) else np.zeros(0, np.uint64)
    for a, b in zip(ends, ends[1:], strict=False):
        h = flat[a:b]
        width = min(size, len(h))
        if not width:
            yield h
            continue
        n = len(h) - width + 1
        x = np.full(n, width, np.uint64)
        for k in range(width):
            x = _mixed(x * _U(0x9E3779B97F4A7C15) + h[k : k + n])
        yield np.unique(x)


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_key"), F.transform(words(ascii_lower(F.col(f"`{text}`"))), lambda w: F.xxhash64(w)).alias("h"))


def signatures(docs: DataFrame, size: int, bands: int, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set, band keys and a sketch of one byte a signature value."""
    functions = bands * rows // 2
    factors = _mixed(np.arange(1, functions + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    lead = _mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                b = whole.slice(first, 1024)
                n, digests, signs = [], [], np.zeros((b.num_rows, 2 * functions), np.uint64)
                for i, s in enumerate(_sets(b.column("h"), size)):
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    if len(s):
                        least, most = np.full(functions, 2**64 - 1, np.uint64), np.zeros(functions, np.uint64)
                        for at in range(0, len(s), 4096):
                            x = factors[:, None] * s[at : at + 4096]
                            np.minimum(least, x.min(1), out=least)
                            np.maximum(most, x.max(1), out=most)
                        signs[i, :functions], signs[i, functions:] = least, most
                keys = np.repeat(lead[None, :], b.num_rows, 0)
                parts = signs.reshape(b.num_rows, bands, rows)
                for k in range(rows):
                    keys = _mixed(keys * _U(31) + parts[:, :, k])
                sketch = (_mixed(signs) >> _U(56)).astype(np.uint8)
                keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), bands).cast(pa.list_(pa.int64()))
                columns = [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), keys, pa.array([r.tobytes() for r in sketch], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "digest", "bands", "sketch"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return _hashed(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, digest binary, bands array<bigint>, sketch binary")


def full_sets(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """digest and set (sorted distinct shingle hashes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                sets = list(_sets(b.column("h").slice(at, 64), size))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), lists], ["digest", "set"])

    return _hashed(docs, doc_id, text).select("h").mapInArrow(run, "digest binary, set array<bigint>")


def _floor(percent: int, values: int) -> int:
    """Equal sketch bytes below which a pair is far under the threshold, by six standard deviations."""
    p = percent / 100
    return int(values * (p - _SLACK * (p * (1 - p) / values) ** 0.5))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def likely(pairs: DataFrame, nodes: DataFrame, percent: int, values: int) -> DataFrame:
    """The pairs (hub, member, blocks) whose sizes and sketches don't rule out the threshold."""
    floor = _floor(percent, values)
    one = lambda x: nodes.select(F.col("id").alias(x), F.col("sketch").alias(f"s_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(one("hub"), "hub").join(one("member"), "member").where(_near_sizes(F.col("n_hub"), F.col("n_member"), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(x.num_rows, values) for c in ("s_hub", "s_member"))
            good = pa.array((a == b).sum(1) >= floor)
            yield pa.RecordBatch.from_arrays([x.column(c).filter(good) for c in ("hub", "member", "blocks")], ["hub", "member", "blocks"])

    return both.select("hub", "member", "blocks", "s_hub", "s_member").mapInArrow(run, "hub long, member long, blocks int")


class _Sets:
    """Full sets, made for the nodes in question alone."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, size: int, doc_id: str, text: str, tables: Tables):
        self.docs = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
        self.nodes, self.size, self.tables = nodes.select("id", "digest", "rep"), size, tables

    def of(self, ids: DataFrame) -> DataFrame:
        """id and set of the given ids."""
        asked = self.tables.store(self.nodes.join(ids, "id", "left_semi"), "asked")
        some = self.docs.join(asked.select(F.col("rep").alias("_id")), "_id", "left_semi")
        sets = full_sets(some, self.size, "_id", "_text").dropDuplicates(["digest"])
        return self.tables.store(sets.join(asked.select("id", "digest"), "digest").select("id", "set"), "sets")


def confirmed(pairs: DataFrame, sets: _Sets, percent: int) -> DataFrame:
    """The links (a, b) among pairs (hub, member, blocks) whose full sets reach the threshold.

    Sets meet row by row in the JVM, never in batches. A hub's members are
    dealt into its blocks, and its set is sent once a block.
    """
    known = sets.of(pairs.select(F.explode(F.array("hub", "member")).alias("id")).distinct())
    block = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block")
    members = pairs.select("hub", "member", "blocks", block).join(known.select(F.col("id").alias("member"), F.col("set").alias("b")), "member")
    hubs = pairs.select("hub", "blocks", block).distinct().join(known.select(F.col("id").alias("hub"), F.col("set").alias("a")), "hub")
    common, total = F.col("common"), F.size("a") + F.size("b")
    both = members.join(hubs, ["hub", "blocks", "block"]).select("hub", "member", total.alias("total"), F.size(F.array_intersect("a", "b")).alias("common"))
    return both.where(100 * common >= percent * (F.col("total") - common)).select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b"))


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """id and label (the smallest id of its component) of every id in the links (a, b)."""
    both = tables.store(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = tables.store(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = tables.store(labels.join(heard, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label")), "lower")
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = tables.store(lower.join(jump, "label").select("id", F.col("next").alias("label"), "was"), "labels")
        changed = not new.where("label <> was").isEmpty()
        tables.drop(labels, lower)
        labels = new
        if not changed:
            tables.drop(both)
            return labels.select("id", "label")


def _tiled(members: DataFrame, nodes: DataFrame, sets: _Sets, percent: int, values: int, tables: Tables) -> DataFrame:
    """Links (a, b) that join components within large buckets: members has key, id, n, size, n_shingles and label.

    The bucket's largest component needs no look at itself: only the others,
    the minor members, meet all. Both are dealt by hash into blocks of about
    TILE documents and at most TILE_SHINGLES shingles, and a block of minor
    members with a block of all is one bounded task. A first pass over
    sketches alone finds the documents of a tile that may be like one of
    another component; their sets alone are sent to the second, which skips
    what its own links have joined already.
    """
    floor = _floor(percent, values)
    parts = members.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("s"))
    main = parts.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("m"), F.max(F.struct("c", "label", "s"))["s"].alias("main_s"))
    rows = members.join(main, "key").withColumn("minor", F.col("label") != F.col("main"))
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(n / TILE), F.ceil(s / TILE_SHINGLES)).cast("int")
    lefts, rights = blocks(F.col("m"), F.col("size") - F.col("main_s")), blocks(F.col("n"), F.col("size"))
    i, j = F.pmod(F.xxhash64("id"), lefts).cast("int"), F.pmod(F.xxhash64("id"), rights).cast("int")
    as_right = F.transform(F.sequence(F.lit(0), lefts - 1), lambda x: F.struct(F.lit(False).alias("left"), x.alias("i"), j.alias("j")))
    as_left = F.transform(F.sequence(F.lit(0), rights - 1), lambda x: F.struct(F.lit(True).alias("left"), i.alias("i"), x.alias("j")))
    rows = rows.select("key", "id", "label", "minor", F.explode(F.when(F.col("minor"), F.concat(as_left, as_right)).otherwise(as_right)).alias("t")).select("key", "id", "label", "minor", "t.*")

    def sides(tile: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """Each row on the left with the rows on the right of other components; two minor ones meet once."""
        left, ids, label, minor = (tile[c].to_numpy() for c in ("left", "id", "label", "minor"))
        right = np.flatnonzero(~left)
        for x in np.flatnonzero(left):
            yield x, right[(label[right] != label[x]) & (~minor[right] | (ids[right] > ids[x]))]

    def sketched(tile: pd.DataFrame) -> pd.DataFrame:
        marks = np.frombuffer(b"".join(tile["sketch"]), np.uint8).reshape(len(tile), values)
        n, wanted = tile["n_shingles"].to_numpy(), np.zeros(len(tile), bool)
        for x, others in sides(tile):
            others = others[100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])]
            others = others[(marks[others] == marks[x]).sum(1) >= floor]
            wanted[others] = True
            wanted[x] |= len(others) > 0
        return tile.loc[wanted, ["key", "id", "label", "minor", "left", "i", "j"]]

    def joined(tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values("id", ignore_index=True)
        marks = np.frombuffer(b"".join(tile["sketch"]), np.uint8).reshape(len(tile), values)
        sets, ids = tile["set"].to_numpy(), tile["id"].to_numpy()
        _, root = np.unique(tile["label"].to_numpy(), return_inverse=True)
        out = []
        for x, others in sides(tile):
            equal = (marks[others] == marks[x]).sum(1)
            for y in others[np.argsort(-equal, kind="stable")][: int((equal >= floor).sum())]:
                if root[x] != root[y] and linked(sets[x], sets[y], percent):
                    root[root == root[y]] = root[x]
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    marks = nodes.select("id", "sketch", "n_shingles")
    wanted = rows.join(marks, "id").groupBy("key", "i", "j").applyInPandas(sketched, "key long, id long, label long, minor boolean, left boolean, i int, j int")
    wanted = tables.store(wanted, "tiles")
    if wanted.isEmpty():
        return wanted.select(F.col("id").alias("a"), F.col("id").alias("b"))
    known = sets.of(wanted.select("id").distinct()).join(marks, "id")
    return wanted.join(known, "id").groupBy("key", "i", "j").applyInPandas(joined, "a long, b long")


def _labelled(docs: DataFrame, size: int, percent: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, group (what it is linked with; null without a set) and component_id of every row.

    Nodes are the distinct sets, numbered when they are written, so rows that
    repeat a doc_id with different texts are documents of their own.
    """
    values = bands * rows
    with Tables(docs.sparkSession) as tables:
        signed = tables.store(signatures(docs, size, bands, rows, doc_id, text), "signatures")
        some = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        sets_ = some.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        nodes = tables.store(sets_.withColumn("id", F.monotonically_increasing_id()), "nodes")
        rows_ = nodes.select("id", "n_shingles", F.explode("bands").alias("key"))
        buckets = tables.store(rows_.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1"), "buckets")
        members = tables.store(rows_.join(buckets.where("n > 2"), "key"), "members")
        blocks = F.ceil(F.col("n") / HUB_BLOCK).cast("int")
        star = members.where("id <> a").select(F.col("a").alias("hub"), F.col("id").alias("member"), blocks.alias("blocks"))
        star = star.union(members.where("id <> a and id <> b").select(F.col("b").alias("hub"), F.col("id").alias("member"), blocks.alias("blocks")))
        star = star.union(buckets.where("n = 2").select("a", "b", F.lit(1)))
        sets = _Sets(docs, nodes, size, doc_id, text, tables)
        first = tables.store(likely(star.groupBy("hub", "member").agg(F.max("blocks").alias("blocks")), nodes, percent, values), "candidates")
        links = tables.store(confirmed(first, sets, percent), "links")
        labels = components(links, tables)

        # What the stars left open: buckets whose members are in several components.
        named = members.select("key", "id", "n", "size", "n_shingles").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        named = tables.store(named, "members")
        marks = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.expr("bit_xor(xxhash64(id))").alias("same")).where("x <> y")
        # Buckets of several bands with the same members are worked off once.
        once = tables.store(marks.join(buckets.select("key", "n"), "key").groupBy("n", "same").agg(F.min("key").alias("key")).select("key"), "open")
        if not once.isEmpty():
            left = tables.store(named.join(once, "key"), "members")
            few = left.where(F.col("n") <= PAIRS_UP_TO)
            p, q = (few.select("key", F.col("id").alias(x), F.col("label").alias(f"l_{x}")) for x in ("hub", "member"))
            pairs = p.join(q, "key").where("hub < member and l_hub <> l_member").select("hub", "member").distinct()
            pairs = pairs.join(first.select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member")), ["hub", "member"], "left_anti")
            more = confirmed(tables.store(likely(pairs.withColumn("blocks", F.lit(1)), nodes, percent, values), "candidates"), sets, percent)
            tiled = _tiled(left.where(F.col("n") > PAIRS_UP_TO), nodes, sets, percent, values, tables)
            labels = components(tables.store(links.union(more).union(tiled), "links"), tables)

        least = nodes.select("id", "rep").join(labels, "id").groupBy("label").agg(F.min("rep").alias("component_id"))
        found = nodes.select("id", "digest", "rep").join(labels, "id", "left").join(least, "label", "left")
        found = found.select("digest", F.coalesce("label", "id").alias("group"), F.coalesce("component_id", "rep").alias("component_id"))
        out = signed.select("doc_id", "text_key", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(found, "digest", "left")
        return stored(out.select("doc_id", "text_key", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id")), "components")


def link_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (doc_id = component_id) of every row."""
    out = _labelled(docs, size, percent, bands, rows, doc_id, text)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id, with the columns it came with.

    Of rows with that doc_id in one component one stays, the first by text and
    then by its other columns; so of blank rows that repeat doc_id and text.
    Rows without a doc_id all stay.
    """
    found = _labelled(docs, size, percent, BANDS, ROWS, "doc_id", "text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    left = rows.join(gone, ["_id", "_key"], "left_anti")
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.coalesce("group", "text_key").alias("_group"))
    repeated = kept.groupBy("_id", "_group").count().where("count > 1").select("_id").distinct()
    if repeated.isEmpty():
        return left.select("_row.*")
    again = left.join(repeated, "_id", "left_semi").join(kept.distinct(), ["_id", "_key"])
    again = again.groupBy("_id", "_group").agg(F.min_by("_row", F.struct("_row.text", F.to_json("_row"))).alias("_row"))
    return left.join(repeated, "_id", "left_anti").select("_row.*").unionByName(again.select("_row.*"))
