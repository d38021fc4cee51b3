"""A content-addressed store of token ids.

Each document's id stream is cut where a rolling hash over sixteen ids meets a
mask, so equal passages become equal chunks wherever they stand. A chunk's
address is the hash of its bytes. The first row with a chunk owns it and keeps
its bytes in its pack; others name the owner in their recipe, so every chunk is
stored once. The Merkle root over the chunk addresses is kept with the recipe,
and reading back verifies it against the bytes.

File format: Parquet rows in ascending doc_id order with ``own`` (the owned
chunks end to end, ids as little-endian unsigned integers of ``width`` bytes: 2
where the vocabulary fits, else 4), the sizes of all chunks, which of them are
owned, the owners of the rest, the root, and the document's place in the stream
of all ids. Only chunk addresses, never payloads, meet to find copies; payloads
move once to be written in order, and again only for chunks owned elsewhere.

Defined results: null is the empty text, which has the end id alone; texts are
stored whole, whatever their length; rows that repeat a doc_id are stored each,
in the order of their roots, and those without one come first; an empty table
gives an empty store; only the id and the text are read. An id that the width
doesn't hold is an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import dropped, new_folder, shuffle_width, stored
from lectern.llm.tokens import encoder, largest_id

END_ID = 1
#: Ids under the rolling hash; mean (a power of two), least and most ids of a chunk.
WINDOW, MEAN, LEAST, MOST = 16, 256, 64, 1024
#: Words of one generation of a worker's table (two generations: some 0.4 GB).
CACHE_WORDS = 500_000
#: The order of the rows of a store: equal roots mean equal ids, so only rows that don't differ are told apart by uid.
ORDER = ("doc_id", "root", "uid")
_U = np.uint64


def _gear(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


#: Of the ids of two bytes, whose low 32 bits are looked up.
_GEARS = _gear(np.arange(1 << 16)).astype(np.uint32)


def marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash meets the mask: ends of possible chunks, in a stream of whole documents.

    A window may reach into the document before only within its first ids, where no chunk ends (LEAST > WINDOW).
    """
    # The mask reads the low bits alone, to which higher ones never carry down: 32 bits do.
    h, k = _GEARS[ids] if not len(ids) or int(ids.max()) < len(_GEARS) else _gear(ids).astype(np.uint32), 1
    while k < WINDOW:  # a window twice as long is two of these, the older one shifted
        h[k:] += h[:-k] << np.uint32(k)
        k *= 2
    return np.flatnonzero(h & np.uint32(MEAN - 1 << WINDOW) == 0) + 1


def _kept(ends: list[int], n: int) -> list[int]:
    """The ends that keep chunks between the least and the most ids, n the last of them."""
    out, last = [], 0
    for end in [*ends, n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST or (end == n > last):
            out.append(end)
            last = end
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """The ends of the chunks of one id stream, the last of them its length."""
    return _kept(marks(ids).tolist(), len(ids))


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    level = leaves or [b""]
    while len(level) > 1:
        level = [address(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _bounded(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of a column each, or one row where it has more."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def _staged(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    """uid, doc_id, n_tokens, sizes (ids of each chunk), addresses, root and payload of every row."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, CACHE_WORDS)
        for b in batches:
            for part in _bounded(b, "text"):
                streams = [ids + end for ids in tool.encode_all(part.column("text").to_pylist())]
                n = [len(x) // 4 for x in streams]
                flat = np.frombuffer(b"".join(streams), "<u4")
                if len(flat) and int(flat.max()) >> 8 * width:
                    raise ValueError(f"id {flat.max()} doesn't fit into {width} bytes")
                found, raw, start = marks(flat), flat.astype(f"<u{width}").tobytes(), 0
                sizes, addresses, roots, payloads = [], [], [], []
                for size in n:
                    own = found[np.searchsorted(found, start + LEAST) : np.searchsorted(found, start + size)] - start
                    ends = _kept(own.tolist(), size)
                    spans = list(zip([0, *ends], ends, strict=False))
                    sizes.append([z - a for a, z in spans])
                    addresses.append([address(raw[width * (start + a) : width * (start + z)]) for a, z in spans])
                    roots.append(merkle_root(addresses[-1]))
                    payloads.append(raw[width * start : width * (start + size)])
                    start += size
                columns = [pa.array(n, pa.int64()), pa.array(sizes, pa.list_(pa.int32())), pa.array(addresses, pa.list_(pa.binary())), pa.array(roots, pa.binary()), pa.array(payloads, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("doc_id"), *columns], ["uid", "doc_id", "n_tokens", "sizes", "addresses", "root", "payload"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return rows.mapInArrow(run, f"uid long, doc_id {kind}, n_tokens long, sizes array<int>, addresses array<binary>, root binary, payload binary")


def _starts(lengths: DataFrame, parts: int) -> DataFrame:
    """uid, doc_id, root and start (the ids of all rows before it in order) of rows with uid, doc_id, root and n_tokens.

    Sums run within range partitions; of each partition only its total meets the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            local = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("root"), pa.array(local), b.column("n_tokens"), pa.array(np.full(len(n), part, np.int32))], ["uid", "doc_id", "root", "local", "n_tokens", "part"])

    kind = lengths.schema["doc_id"].dataType.simpleString()
    dealt = lengths.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    local = stored(dealt.mapInArrow(run, f"uid long, doc_id {kind}, root binary, local long, n_tokens long, part int"), "starts")
    totals = sorted(local.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, so_far = [], 0
    for part, n in totals:
        before.append((part, so_far))
        so_far += n
    table = local.sparkSession.createDataFrame(before or [(0, 0)], "part int, before long")
    return local.join(F.broadcast(table), "part").select("uid", "doc_id", "root", (F.col("local") + F.col("before")).alias("start"))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write the store of all documents at ``path``."""
    spark = docs.sparkSession
    width = 2 if max(end_id, largest_id(vocabulary)) < 1 << 16 else 4
    parts = shuffle_width(spark)
    stage = new_folder(spark, "stage")
    _staged(docs, vocabulary, end_id, width).write.option("compression", "zstd").parquet(stage)
    staged = spark.read.parquet(stage)
    refs = staged.select("uid", F.posexplode("addresses").alias("seq", "address"))
    # A hash aggregate of two numbers over all addresses; the owner's place is looked up among the shared ones alone.
    shared = refs.groupBy("address").agg(F.min("uid").alias("owner"), F.count("*").alias("n")).where("n > 1").select("address", "owner")
    copies = stored(refs.join(shared, "address").select("uid", "seq", "address", "owner"), "copies")
    places = stored(copies.where("uid = owner").groupBy("address").agg(F.min("seq").alias("at")), "places")
    other = copies.join(places, "address").where("not (uid = owner and seq = at)")
    owners = other.groupBy("uid").agg(F.collect_list(F.struct("seq", "owner", "at")).alias("elsewhere"))
    starts = _starts(staged.select("uid", "doc_id", "root", "n_tokens"), parts)
    head = starts.join(owners, "uid", "left").select("doc_id", "uid", "root", F.lit(0).alias("kind"), "start", "elsewhere")
    rows = head.unionByName(staged.drop("addresses").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER, "kind")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, uid long, start long, n_tokens long, sizes array<int>, elsewhere array<struct<seq:int,owner:bigint,at:int>>, root binary, own binary, width int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            # A document's two rows stand side by side, its place first and its payload second.
            t = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            n = t.num_rows // 2
            left = t.slice(2 * n)
            if not n:
                continue
            first, second = t.take(pa.array(range(0, 2 * n, 2))), t.take(pa.array(range(1, 2 * n, 2)))
            elsewhere, own = first.column("elsewhere").combine_chunks(), second.column("payload").combine_chunks()
            sizes = second.column("sizes").combine_chunks()
            if elsewhere.null_count < n:
                kept = own.to_numpy(zero_copy_only=False).tolist()
                for i, (chunks, gone) in enumerate(zip(_lists(sizes), _lists(elsewhere, "seq"), strict=True)):
                    if gone:
                        kept[i] = b"".join(_not_elsewhere(chunks, gone, kept[i], width))
                own = pa.array(kept, pa.binary())
            columns = [first.column("doc_id"), first.column("uid"), first.column("start"), second.column("n_tokens"), sizes, elsewhere, second.column("root"), own, pa.array(np.full(n, width, np.int32))]
            yield from pa.Table.from_arrays(columns, ["doc_id", "uid", "start", "n_tokens", "sizes", "elsewhere", "root", "own", "width"]).combine_chunks().to_batches()

    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    dropped(spark, stage)


def _lists(column: pa.ListArray, field: str | None = None) -> list[list[int]]:
    """A column's lists of numbers, or of one field's numbers, empty where null."""
    values = column.flatten()
    values = (values.field(field) if field else values).to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum([0, *pc.list_value_length(column).fill_null(0).to_pylist()]).tolist()
    return [values[a:z] for a, z in zip(ends, ends[1:], strict=False)]


def _not_elsewhere(sizes: list[int], gone: Collection[int], payload: bytes, width: int) -> list[bytes]:
    """The chunks of a whole payload that the document owns."""
    gone, at, out = {*gone}, 0, []
    for seq, n in enumerate(sizes):
        if seq not in gone:
            out.append(payload[at : at + width * n])
        at += width * n
    return out


def _pieces(sizes: list[int], gone: Collection[int], own: bytes, width: int) -> dict[int, bytes]:
    """The owned chunks of one pack row by their place."""
    gone, at, out = {*gone}, 0, {}
    for seq, n in enumerate(sizes):
        if seq not in gone:
            out[seq] = own[at : at + width * n]
            at += width * n
    return out


def _rows(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple]:
    """The rows of a batch, with the places alone of ``elsewhere``."""
    columns = [(n, batch.column(n)) for n in names]
    made = [_lists(c, "seq" if n == "elsewhere" else None) if pa.types.is_list(c.type) else c.to_pylist() for n, c in columns]
    yield from zip(*made, strict=True)


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, verified against its root.

    digest: the crc32 of those ids (ids_crc32) in place of the ids, which then never leave the worker.
    """
    packs = spark.read.parquet(path)
    width = (packs.select("width").first() or [2])[0]
    last = "ids_crc32" if digest else "ids"
    names = ["doc_id", "uid", "start", "n_tokens", "sizes", "elsewhere", "root", "own"]
    kind = packs.schema["doc_id"].dataType.simpleString()
    asked = packs.select("uid", F.explode("elsewhere").alias("e")).select("uid", "e.seq", F.col("e.owner").alias("owner"), F.col("e.at").alias("at"))

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = _rows(b.slice(at, 256), ("uid", "sizes", "elsewhere", "own"))
                found = [(uid, seq, chunk) for uid, sizes, gone, own in rows for seq, chunk in _pieces(sizes, gone, own, width).items()]
                owner, seq, chunk = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(seq, pa.int32()), pa.array(chunk, pa.binary())], ["owner", "at", "chunk"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(r: tuple, more: dict[int, bytes]) -> tuple:
            doc_id, start, n_tokens, sizes, gone, root, own = r
            parts = _pieces(sizes, gone, own, width) | more
            chunks = [parts[seq] for seq in range(len(sizes))]
            if merkle_root([address(c) for c in chunks]) != root:
                raise ValueError(f"document {doc_id}: its chunks do not match its Merkle root")
            ids = np.frombuffer(b"".join(chunks), f"<u{width}").astype("<u4").tobytes()
            return doc_id, start, n_tokens, zlib.crc32(ids) if digest else ids

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (id_kind, pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", last])

        taken = ("doc_id", "start", "n_tokens", "sizes", "elsewhere", "root", "own")
        row, more, out = None, {}, []
        for b in batches:
            id_kind = b.schema.field("doc_id").type
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                seqs, chunks = (part.column(n).to_pylist() for n in ("seq", "chunk")) if "seq" in b.schema.names else ([-1] * part.num_rows,) * 2
                for r, seq, chunk in zip(_rows(part, taken), seqs, chunks, strict=True):
                    if seq < 0:
                        if row is not None:
                            out.append(done(row, more))
                        row, more = r, {}
                    else:
                        more[seq] = chunk
                if out:
                    yield batch(out)
                    out = []
        if row is not None:
            yield batch([done(row, more)])

    result = f"doc_id {kind}, start long, n_tokens long, {last} {'long' if digest else 'binary'}"
    alone = packs.where("elsewhere is null").select(*names).mapInArrow(assemble, result)
    wanted = asked.select(F.col("owner").alias("uid")).distinct()
    served = packs.join(wanted, "uid", "left_semi").select(*names).mapInArrow(serve, "owner long, at int, chunk binary")
    moved = asked.join(served, ["owner", "at"]).select("uid", "seq", "chunk")
    parted = packs.where("elsewhere is not null").select(*names).withColumn("seq", F.lit(-1)).unionByName(moved, allowMissingColumns=True)
    parted = parted.repartition(shuffle_width(spark), "uid").sortWithinPartitions("uid", "seq")
    return alone.unionByName(parted.mapInArrow(assemble, result))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the store in the shared folder and read it back: doc_id, start, n_tokens and ids_crc32 of every document."""
    path = new_folder(docs.sparkSession, "token-store")
    write(docs, path, vocabulary)
    return read(docs.sparkSession, path, digest=True)
