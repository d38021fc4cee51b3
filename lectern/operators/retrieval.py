"""Exact vector search, reranking, ordering and packing of what was retrieved.

Long form throughout: one row per (question, rank).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vector import doubles, squared_l2
from lectern.sources.stage import small_batches, stored

#: Bytes of one block of vectors, in double precision; blocks of queries meet blocks of chunks.
BLOCK_BYTES = 4 << 20
#: Bytes of one matrix of products, queries by rows, within a task.
MATRIX_BYTES = 4 << 20
#: Bytes of the blocks of chunks that one task goes through.
TASK_BYTES = 128 << 20
#: Decimal places to which distances are compared, so that equal ones order by id.
PLACES = 9


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """id (long) and vector, packed: one row of n, ids and vectors as bytes for about BLOCK_BYTES."""
    most = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, size = [], [], 0

        def packed() -> pa.RecordBatch:
            all_ids, all_vectors = np.concatenate(ids), np.concatenate(vectors)
            return pa.RecordBatch.from_arrays([pa.array([len(all_ids)], pa.int64()), pa.array([all_ids.tobytes()], pa.binary()), pa.array([all_vectors.tobytes()], pa.binary())], [f"{name}_n", f"{name}_ids", f"{name}_vectors"])

        for b in batches:
            if not len(b):
                continue
            x, names = _matrix(b.column("vector")), b.column("id").to_numpy()
            step = max(1, most // max(1, x[0].nbytes))
            for at in range(0, len(x), step):
                if ids and size + x[at : at + step].nbytes > most:
                    yield packed()
                    ids, vectors, size = [], [], 0
                ids.append(names[at : at + step])
                vectors.append(x[at : at + step])
                size += vectors[-1].nbytes
        if ids:
            yield packed()

    return stored(rows.mapInArrow(run, f"{name}_n long, {name}_ids binary, {name}_vectors binary"), "vectors")


def _rounded(x: np.ndarray) -> np.ndarray:
    """To PLACES as Spark's round does: by the shortest decimal that names a double, halves up."""
    scaled = x * 10.0**PLACES
    out = np.where(x < 2.0**22, np.floor(scaled + 0.5) / 10.0**PLACES, x)
    for k in np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4) & (x < 2.0**22)):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-PLACES), ROUND_HALF_UP))
    return out


class _Nearest:
    """The k nearest rows so far of a tile of queries, ties by id.

    Products in single precision, with a bound on their error, find the rows
    that can be near enough; the distance of those is then exact.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.own = (vectors**2).sum(1)
        self.last = np.full(len(ids), np.inf)  # the distance of the k-th so far
        self.q, self.d, self.c = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def meet(self, names: np.ndarray, x: np.ndarray, squares: np.ndarray, wide: np.ndarray) -> None:
        """Rows x with their squared norms; wide: the same with minus half the squares below, transposed, in the precision to multiply in."""
        size = float(np.sqrt(squares.max()))
        v = np.empty((len(self.v), self.v.shape[1] + 1), wide.dtype)
        v[:, :-1], v[:, -1] = self.v, 1
        near = v @ wide
        slack = (8 + v.shape[1]) * float(np.finfo(wide.dtype).eps) * (np.sqrt(self.own) + size) ** 2
        least = (self.own - self.last - 10.0**-PLACES) / 2 - slack
        fresh = np.isinf(self.last)
        if fresh.any() and len(x) > self.k + 1:  # one more than k, since a query isn't its own neighbour
            some = np.partition(near[fresh], len(x) - self.k - 1, 1)[:, len(x) - self.k - 1]
            least[fresh] = some - 2 * slack[fresh] - 10.0**-PLACES
        least = np.where(np.isnan(least), -np.inf, least - np.abs(least) * float(np.finfo(wide.dtype).eps))
        at = np.flatnonzero(near >= least.astype(wide.dtype)[:, None])
        for p in range(0, len(at), 4096):
            q, j = np.divmod(at[p : p + 4096], len(x))
            other = self.ids[q] != names[j]
            q, j = q[other], j[other]
            apart = self.v.take(q, 0) - x.take(j, 0)
            d = np.cumsum(apart * apart, 1)[:, -1]  # in order, as the expression over arrays adds
            d = _rounded(d)
            keep = np.isfinite(d) & (d <= self.last[q])
            self.new.append((q[keep], d[keep], names[j[keep]]))
            self.waiting += int(keep.sum())
            if self.waiting > 4 * len(self.ids) * self.k:
                self.settle()
        if fresh.any() or self.waiting > len(self.ids):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        q, d, c = (np.concatenate(x) for x in zip((self.q, self.d, self.c), *self.new, strict=True))
        self.new, self.waiting = [], 0
        order = np.lexsort((c, d, q))
        q, d, c = q[order], d[order], c[order]
        first = np.searchsorted(q, np.arange(len(self.ids)))
        keep = np.arange(len(q)) - first[q] < self.k
        self.q, self.d, self.c = q[keep], d[keep], c[keep]
        count = np.bincount(self.q, minlength=len(self.ids))
        full = count >= self.k
        self.last[full] = self.d[(np.cumsum(count) - 1)[full]]


def _best(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: the k nearest of the chunks in its blocks for each query of its blocks. A block of queries meets all blocks of chunks in turn."""
    cells = MATRIX_BYTES // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tiles = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for t in tiles:
                t.settle()
                if len(t.q):
                    yield pa.RecordBatch.from_arrays([pa.array(t.ids[t.q]), pa.array(t.c), pa.array(t.d)], ["qid", "chunk_id", "distance"])

        for b in batches:
            for r in range(len(b)):
                ids = np.frombuffer(b.column("q_ids")[r].as_buffer(), np.int64)
                if now is None or len(now) != len(ids) or (now != ids).any():
                    yield from done()
                    now, v = ids.copy(), np.frombuffer(b.column("q_vectors")[r].as_buffer()).reshape(len(ids), -1).copy()
                    rows = max(1, min(512, cells // 64))
                    tiles = [_Nearest(now[a : a + rows], v[a : a + rows], k) for a in range(0, len(now), rows)]
                    largest = float(np.abs(v).max(initial=0))
                names = np.frombuffer(b.column("c_ids")[r].as_buffer(), np.int64)
                x = np.frombuffer(b.column("c_vectors")[r].as_buffer()).reshape(len(names), -1)
                most = max(largest, float(np.abs(x).max(initial=0)))
                # Beyond these sizes single precision overflows, or loses what is small.
                kind = np.float32 if 1e-6 < most < 1e12 else np.float64
                squares, step = (x**2).sum(1), max(1, cells // rows)
                wide = np.concatenate([x.T, -squares[None] / 2]).astype(kind)
                for a in range(0, len(names), step):
                    right = np.ascontiguousarray(wide[:, a : a + step])
                    for t in tiles:
                        t.meet(names[a : a + step], x[a : a + step], squares[a : a + step], right)
        yield from done()

    return run


def ranked(pairs: DataFrame, k: int, *more: str) -> DataFrame:
    """Rows (qid, chunk_id, distance) with ranks 1 to k by distance, ties by id."""
    order = Window.partitionBy("qid").orderBy("distance", "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "chunk_id", "distance", *more)


def knn_global(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """qid, rank, chunk_id, distance (squared L2) of the k nearest chunks of every query; a query is not its own neighbour.

    queries: qid, vector; chunks: chunk_id, vector. Both are packed in blocks of
    BLOCK_BYTES; a task has some blocks of each, and keeps k rows a query. No
    vector reaches the driver. Of chunks with the very same vector the k + 1
    first ids are enough, since equal distances order by id.
    """
    spark = queries.sparkSession
    same = Window.partitionBy("vector").orderBy("id")
    given = chunks.select(F.col("chunk_id").cast("long").alias("id"), doubles(F.col("vector")).alias("vector")).where("vector is not null")
    c = _blocks(given.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).drop("_r"), "c")
    q = _blocks(queries.select(F.col("qid").cast("long").alias("id"), doubles(F.col("vector")).alias("vector")).where("vector is not null"), "q")
    (n_q, n_c), slots = (x.count() for x in (q, c)), max(1, spark.sparkContext.defaultParallelism)
    wide = max(-(-n_c * BLOCK_BYTES // TASK_BYTES), -(-2 * slots // max(1, n_q)))
    # By range of a hash, the few blocks are dealt evenly.
    q, c = q.repartitionByRange(max(1, n_q), F.xxhash64("q_ids")), c.repartitionByRange(max(1, min(wide, n_c)), F.xxhash64("c_ids"))
    met = q.hint("shuffle_replicate_nl").crossJoin(c)  # blocks, not rows
    with small_batches(spark, 4 * BLOCK_BYTES):
        pairs = stored(met.mapInArrow(_best(k), "qid long, chunk_id long, distance double"), "near")
    return ranked(pairs, k)


def knn_local(queries: DataFrame, chunks: DataFrame, k: int, book: str = "book") -> DataFrame:
    """As ``knn_global`` within the query's own book, by an equi-join on it."""
    q = queries.select("qid", book, F.col("vector").alias("q"))
    x = chunks.select("chunk_id", book, F.col("vector").alias("x"))
    pairs = q.join(x, book).where("qid <> chunk_id")
    return ranked(pairs.select("qid", "chunk_id", F.round(squared_l2(doubles(F.col("q")), doubles(F.col("x"))), PLACES).alias("distance")), k)


def rerank_nothing(found: DataFrame, top_k: int, order_preserve: bool = False) -> DataFrame:
    """The first k in retrieval order, each with score 1 (TK-1)."""
    kept = found.where(F.col("rank") <= top_k).withColumn("score", F.lit(1.0))
    return in_document_order(kept) if order_preserve else kept


def rerank(found: DataFrame, score: Column, top_k: int, order_preserve: bool = False) -> DataFrame:
    """The k best by score, ties in retrieval order (TK-2). score: an expression over the rows, also a pandas UDF."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    kept = found.withColumn("score", score).withColumn("_new", F.row_number().over(order)).where(F.col("_new") <= top_k).drop("rank").withColumnRenamed("_new", "rank")
    return in_document_order(kept) if order_preserve else kept


def in_document_order(found: DataFrame) -> DataFrame:
    """Ranks anew by chunk id within a question (TK-4)."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id")))


RERANKERS = {"nothing": rerank_nothing, "reranker": rerank}


def reranker(name: str) -> Callable[..., DataFrame]:
    """The reranker of a name; ValueError for any other (TK-3)."""
    if name not in RERANKERS:
        raise ValueError(f"no reranker named {name!r}")
    return RERANKERS[name]


def within_budget(found: DataFrame, limit: int, tokens: str = "tokens_len", overhead: int = 0) -> DataFrame:
    """Chunks in rank order up to the first that would exceed the token limit (TK-5)."""
    so_far = F.sum(tokens).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("running_tokens", so_far).where(F.col("running_tokens") <= limit - overhead)


def ir_metrics(found: DataFrame, questions: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Per question: hit_rank (first relevant rank), hits and dcg in the top k, total_relevant, and the metrics.

    found: qid, rank, is_good; questions: qid, book; relevant: book,
    total_relevant. Questions without a result count with zeros.
    """
    top = found.where(F.col("rank") <= k)
    per = top.groupBy("qid").agg(
        F.min(F.when(F.col("is_good"), F.col("rank"))).alias("hit_rank"),
        F.count_if("is_good").alias("hits"),
        F.sum(F.when(F.col("is_good"), 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias("dcg"),
    )
    out = questions.join(per, "qid", "left").join(relevant, "book", "left").fillna(0, ["hits", "total_relevant"]).fillna(0.0, ["dcg"])
    ideal_n = F.when(F.col("total_relevant") > 0, F.least(F.col("total_relevant"), F.lit(k))).otherwise(F.col("hits")).cast("int")
    ideal = F.aggregate(F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: i <= ideal_n), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    return out.select(
        "qid", "book", "hit_rank", "hits", "total_relevant",
        *[F.when(F.col("hit_rank") <= i, 1.0).otherwise(0.0).alias(f"accuracy_at_{i}") for i in range(1, 6)],
        F.when(F.col("total_relevant") > 0, F.col("hits") / F.col("total_relevant")).otherwise(0.0).alias("recall"),
        F.coalesce(1 / F.col("hit_rank"), F.lit(0.0)).alias("mrr"),
        F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


METRICS = [*[f"accuracy_at_{i}" for i in range(1, 6)], "recall", "mrr", "ndcg"]


def mean_metrics(per_question: DataFrame, *keys: str, places: int = 4) -> DataFrame:
    """Means over all questions, rounded; zeros where there are none (IR-1 to IR-5)."""
    return per_question.groupBy(*keys).agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), places).alias(m) for m in METRICS], F.count("*").alias("n_questions"))


def answerability(found: DataFrame) -> DataFrame:
    """all_hit, partial_hit or no_hit of each question over its configurations (AG-3). found: qid, config, hit."""
    c = found.groupBy("qid").agg(F.bool_and("hit").alias("all"), F.bool_or("hit").alias("some"))
    return c.select("qid", F.when(F.col("all"), "all_hit").when(F.col("some"), "partial_hit").otherwise("no_hit").alias("answerability"))
