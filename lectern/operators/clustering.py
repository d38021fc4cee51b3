"""Embedding-space metrics as closed forms over sums, without pairwise matrices where algebra allows.

rows: id, label, vector (array<double>). Vectors are exploded to (position,
value) and summed, so aggregates combine before they are shuffled; only label
centroids (labels × dimensions) meet each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.vector import dot, doubles, norm
from lectern.registry import embedding_metrics

EPS = 1e-12


def unit(v: Column) -> Column:
    # The norm as a list of one, so that it is worked out once a row and not once an element.
    return F.get(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))), F.lit(0))


def prepared(df: DataFrame, id_column: str, label: str, vector: str) -> DataFrame:
    return df.select(F.col(id_column).alias("id"), F.col(label).alias("label"), doubles(F.col(vector)).alias("v"))


def sums(rows: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """keys, n (or the weight's sum) and s: the sum of (weighted) vectors as an array in order."""
    w = F.col(weight) if weight else F.lit(1.0)
    each = rows.select(*keys, w.alias("w"), F.posexplode("v").alias("p", "x"))
    flat = each.groupBy(*keys, "p").agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.sum("w").alias("w"))
    packed = F.array_sort(F.collect_list(F.struct("p", "x")))  # one entry a dimension
    return flat.groupBy(*keys).agg(F.max("w").alias("n"), F.transform(packed, lambda e: e["x"]).alias("s"))


def centroids(rows: DataFrame, weight: str | None = None) -> DataFrame:
    s = sums(rows, "label", weight=weight)
    return s.select("label", "n", F.transform("s", lambda x: x / (F.col("n") + (EPS if weight else 0.0))).alias("c"))


def sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)


def cosine_distance(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return 1 - F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def _apart(cs: DataFrame, distance: Column) -> DataFrame:
    """All pairs of labels (a few times a few): label, other, d."""
    other = cs.select(F.col("label").alias("other"), F.col("c").alias("c2"), F.col("n").alias("n2"))
    return cs.join(other, F.col("label") != F.col("other")).withColumn("d", distance)


def _of(a: str, b: str) -> tuple[Column, Column]:
    return F.col(a), F.col(b)


@embedding_metrics.register("calinski_harabasz")
def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """Between to within dispersion (EM-1)."""
    per = sums(rows, "label").select("n", dot(F.col("s"), F.col("s")).alias("s2"))
    whole = sums(rows.withColumn("k", F.lit(0)), "k").select(dot(F.col("s"), F.col("s")).alias("t2"), F.col("n").alias("big"))
    squares = rows.agg(F.sum(dot(F.col("v"), F.col("v"))).alias("q"))
    x = per.agg(F.sum(F.col("s2") / F.col("n")).alias("b"), F.count("*").alias("k")).crossJoin(whole).crossJoin(squares)  # one row each
    between, within = F.col("b") - F.col("t2") / F.col("big"), F.col("q") - F.col("b")
    return x.select((between * (F.col("big") - F.col("k")) / (within * (F.col("k") - 1))).alias("calinski_harabasz"))


@embedding_metrics.register("davies_bouldin")
def davies_bouldin(rows: DataFrame) -> DataFrame:
    """Mean over labels of the worst ratio of spreads to centroid distance (EM-2)."""
    cs = centroids(rows)
    spread = rows.join(cs.select("label", "c"), "label").groupBy("label").agg(F.avg(F.sqrt(sq(*_of("v", "c")))).alias("sp"))
    cs = cs.join(spread, "label")
    pairs = _apart(cs, F.sqrt(sq(*_of("c", "c2")))).join(spread.select(F.col("label").alias("other"), F.col("sp").alias("sp2")), "other")
    worst = pairs.groupBy("label").agg(F.max((F.col("sp") + F.col("sp2")) / F.col("d")).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


@embedding_metrics.register("silhouette")
def silhouette(rows: DataFrame) -> DataFrame:
    """Cosine silhouette by label sums of unit vectors: linear in rows times labels (EM-3)."""
    u = rows.select("id", "label", unit(F.col("v")).alias("v"))
    table = sums(u, "label")
    each = u.crossJoin(table.select(F.col("label").alias("other"), "n", "s"))  # a row for each label, of which there are few
    own = F.col("label") == F.col("other")
    far = F.when(own, F.when(F.col("n") > 1, (F.col("n") - dot(*_of("v", "s"))) / (F.col("n") - 1)))
    away = F.when(~own, 1 - dot(*_of("v", "s")) / F.col("n"))
    per = each.groupBy("id").agg(F.max(far).alias("a"), F.min(away).alias("b"))
    return per.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


@embedding_metrics.register("inter_intra")
def inter_intra(rows: DataFrame) -> DataFrame:
    """Mean cosine within and between labels, separation and ratio, from sums alone (EM-4)."""
    u = rows.select("id", "label", unit(F.col("v")).alias("v"))
    per = sums(u, "label").select("n", dot(*_of("s", "s")).alias("s2"))
    x = per.agg(F.sum("s2").alias("a"), F.sum(F.col("n") * (F.col("n") - 1)).alias("p"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum("n").alias("big"))
    whole = sums(u.withColumn("k", F.lit(0)), "k").select(dot(*_of("s", "s")).alias("t2"))
    self_ = u.agg(F.sum(dot(*_of("v", "v"))).alias("q"))
    x = x.crossJoin(whole).crossJoin(self_)  # one row each
    intra, inter = (F.col("a") - F.col("q")) / F.col("p"), (F.col("t2") - F.col("a")) / (F.col("big") * F.col("big") - F.col("n2"))
    return x.select(inter.alias("inter"), intra.alias("intra"), (intra - inter).alias("separation"), (intra / (inter + 1e-8)).alias("ratio"), F.col("big").cast("long").alias("n_used"))


def members(df: DataFrame, id_column: str, labels: Column, vector: str, by_count: bool = True) -> DataFrame:
    """Fuzzy memberships in long form: id, label, u (one over the number of labels) and v (EM-12)."""
    u = 1 / F.size("ls") if by_count else F.lit(1.0)
    x = df.select(F.col(id_column).alias("id"), F.array_distinct(labels).alias("ls"), doubles(F.col(vector)).alias("v"))
    return x.where(F.size("ls") > 0).select("id", F.explode("ls").alias("label"), u.alias("u"), "v")


def _fuzzy(m: DataFrame) -> DataFrame:
    return centroids(m.withColumn("w", F.col("u") * F.col("u")), "w")


@embedding_metrics.register("soft_fuzzy_dunn")
def fuzzy_dunn(m: DataFrame) -> DataFrame:
    """Least centroid distance over the largest weighted spread (EM-8)."""
    cs = _fuzzy(m)
    near = _apart(cs, cosine_distance(*_of("c", "c2"))).agg(F.min("d").alias("near"))
    w = F.col("u") * F.col("u")
    wide = m.join(cs.select("label", "c"), "label").groupBy("label").agg((F.sum(w * cosine_distance(*_of("v", "c"))) / (F.sum(w) + EPS)).alias("x")).agg(F.max("x").alias("wide"))
    return near.crossJoin(wide).select((F.col("near") / (F.col("wide") + EPS)).alias("soft_fuzzy_dunn"))


@embedding_metrics.register("soft_fuzzy_silhouette")
def fuzzy_silhouette(m: DataFrame) -> DataFrame:
    """Silhouette against centroids, weighted by the lead of the first membership over the second (EM-9)."""
    cs = _fuzzy(m).select("label", "c")
    top = m.groupBy("id").agg(F.min(F.struct((-F.col("u")).alias("u"), "label")).alias("t"), F.first("v").alias("v"), F.count("*").alias("k"), F.max("u").alias("u1"))
    # With equal shares the lead is the whole share for one label and none for several.
    top = top.select("id", "v", F.col("t.label").alias("own"), F.when(F.col("k") > 1, 0.0).otherwise(F.col("u1")).alias("w"))
    d = cosine_distance(*_of("v", "c"))
    per = top.crossJoin(cs).groupBy("id").agg(F.first("w").alias("w"), F.max(F.when(F.col("label") == F.col("own"), d)).alias("a"), F.min(F.when(F.col("label") != F.col("own"), d)).alias("b"))
    s = (F.col("b") - F.col("a")) / (F.greatest("a", "b") + EPS)
    return per.agg((F.sum(F.col("w") * s) / (F.sum("w") + EPS)).alias("soft_fuzzy_silhouette"))


@embedding_metrics.register("xie_beni_index")
def xie_beni(m: DataFrame) -> DataFrame:
    """Weighted squared spread to all centroids over rows times least squared centroid distance (EM-10)."""
    cs = _fuzzy(m)
    near = _apart(cs, cosine_distance(*_of("c", "c2"))).agg(F.min(F.col("d") * F.col("d")).alias("near"))
    d = cosine_distance(*_of("v", "c"))
    top = m.join(cs.select("label", "c"), "label").agg(F.sum(F.col("u") * F.col("u") * d * d).alias("top"))
    n = m.agg(F.countDistinct("id").alias("n"))
    return top.crossJoin(near).crossJoin(n).select((F.col("top") / (F.col("n") * F.col("near") + EPS)).alias("xie_beni_index"))


@embedding_metrics.register("knn_temporal_consistency")
def knn_consistency(rows: DataFrame, k: int = 10) -> DataFrame:
    """Mean gap of labels to the k nearest rows by cosine (EM-5): rows against all rows in blocks of bounded size."""
    from lectern.operators.retrieval import knn_global
    from lectern.sources.stage import stored

    u = stored(rows.select("id", "label", unit(F.col("v")).alias("v")), "unit")
    near = knn_global(u.select(F.col("id").alias("qid"), F.col("v").alias("vector")), u.select(F.col("id").alias("chunk_id"), F.col("v").alias("vector")), k)
    pairs = near.join(u.select(F.col("id").alias("qid"), "label"), "qid").join(u.select(F.col("id").alias("chunk_id"), F.col("label").alias("other")), "chunk_id")
    gap = pairs.groupBy("qid").agg(F.avg(F.abs(F.col("label") - F.col("other"))).alias("gap"))
    return gap.agg(F.avg("gap").alias("knn_temporal_consistency"))


#: Bytes of one block of vectors that travels to the tasks, and pairs worked on at once within a task.
MANTEL_BYTES, MANTEL_TILE = 32 << 20, 1 << 20
#: Distances count in units of 1e-9. Buckets of them, and units that a task counts one by one in a table.
UNITS, BUCKETS, TABLE_UNITS = 10**9, 1 << 18, 1 << 26
#: Pairs that a part grows to however wide it gets, and pairs of a part from which they are counted in a table, not held.
PART_PAIRS, HEAVY_PAIRS = 1 << 22, 1 << 22


def _gap_ranks(labels):
    """The distinct gaps of labels over all pairs, in order, with their average ranks and counts."""
    import numpy as np

    values, times = np.unique(labels, return_counts=True)
    gaps, counts = np.zeros(1, values.dtype), np.array([int((times * (times - 1) // 2).sum())])
    for k in range(1, len(values)):
        gaps = np.concatenate([gaps, values[k] - values[:k]])
        counts = np.concatenate([counts, times[k] * times[:k]])
        if k % 64 == 0 or k == len(values) - 1:
            gaps, at = np.unique(gaps, return_inverse=True)
            counts = np.bincount(at, counts).astype(np.int64)
    gaps, counts = gaps[counts > 0], counts[counts > 0]
    return gaps, np.cumsum(counts) - counts + (counts + 1) / 2, counts


def _distance_parts(count, width: int, slots: int):
    """Ranges of distance [low, high) in units with the pairs before and in them; those with most pairs come first.

    A part is narrow enough for a table or has few enough pairs to hold.
    """
    import numpy as np

    used = np.flatnonzero(count)
    span, before = int(used[-1] - used[0] + 1) * width, np.cumsum(count) - count
    waves = -(-span // (TABLE_UNITS * slots))  # parts of a table each, as many as all slots have work for
    most = max(-(-span // (waves * slots)), width)
    few, share = min(PART_PAIRS, HEAVY_PAIRS), int(count.sum()) // (waves * slots)
    out, first, last, pairs = [], int(used[0]), int(used[0]), 0
    for b in used.tolist():
        wide = (b + 1 - first) * width > most or pairs + int(count[b]) > share
        if pairs and wide and pairs + int(count[b]) > few:
            out.append((first * width, (last + 1) * width, int(before[first]), pairs))
            first, pairs = b, 0
        last, pairs = b, pairs + int(count[b])
    out.append((first * width, (last + 1) * width, int(before[first]), pairs))
    return sorted(out, key=lambda x: -x[3])


@embedding_metrics.register("mantel_test")
def mantel(rows: DataFrame, permutations: int = 199, seed: int = 42) -> DataFrame:
    """Spearman correlation of cosine distances and label gaps over all pairs of all rows, with a permutation p (EM-6).

    No pair is shuffled or stored. A first pass counts the distances by
    bucket; then each task takes a range of distances, whose first rank is
    known, goes through all pairs and ranks those in its range: few are held
    and sorted, many are counted in a table of bounded size and met once more.
    Gaps are ranked from the counts of the labels. Only counts and sums reach
    the driver, and one label a row; the vectors travel in blocks.
    """
    import numpy as np
    import pyarrow as pa

    from lectern.sources.stage import numbered

    spark = rows.sparkSession
    at = numbered(rows.select("id", "label", "v"), "id")
    told = at.select("number", "label").toPandas().sort_values("number")
    labels, n = told["label"].to_numpy(), len(told)
    kind = "mantel_corr double, mantel_p_value double"
    if n < 3:
        return spark.createDataFrame([(None, None)], kind)
    if not np.issubdtype(labels.dtype, np.integer):
        labels = labels.astype(float)
    gaps, gap_rank, gap_counts = _gap_ranks(labels)
    total = n * (n - 1) // 2
    mean = (total + 1) / 2
    width, units, tile = -(-(2 * UNITS + 1) // BUCKETS), UNITS, MANTEL_TILE
    slots, heavy = max(spark.sparkContext.defaultParallelism, 1), HEAVY_PAIRS

    size = max(1, MANTEL_BYTES // (8 * len(at.select("v").first()[0])))
    blocks = []
    for low in range(0, n, size):
        part = at.where((F.col("number") >= low) & (F.col("number") < low + size)).select("number", "v").toArrow().sort_by("number").combine_chunks()
        v = np.stack(part.column("v").to_numpy()).astype(float)
        blocks.append((low, spark.sparkContext.broadcast(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), EPS))))

    side = max(1, int(tile**0.5) // 2)

    def corners():
        """Row and column, within their blocks, of the tiles that have pairs i < j."""
        for low, block in blocks:
            for a in range(0, len(block.value), side):
                for other, theirs in blocks[blocks.index((low, block)) :]:
                    for c in range(a if other == low else 0, len(theirs.value), 4 * side):
                        yield low, a, other, c

    def no_others(s, low, a, other, c):
        """NaN for what isn't i < j in a tile on the diagonal."""
        if other == low and c < a + len(s):
            s[np.arange(a, a + len(s))[:, None] >= np.arange(c, c + s.shape[1])[None]] = np.nan

    def in_units(s):
        return np.clip(np.rint((1 - s) * units), 0, 2 * units).astype(np.int64)

    def by_bucket(batches):
        for b in batches:
            for share in b.column("id").to_pylist():
                count = np.zeros(-(-(2 * units + 1) // width), np.int64)
                at_block = {low: block.value for low, block in blocks}
                for low, a, other, c in corners():
                    if (low + a) // side % slots != share:
                        continue
                    s = at_block[low][a : a + side] @ at_block[other][c : c + 4 * side].T
                    no_others(s, low, a, other, c)
                    count += np.bincount(in_units(s[~np.isnan(s)]) // width, minlength=len(count))
                keys = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(count[keys])], ["key", "n"])

    found = spark.range(0, slots, 1, slots).mapInArrow(by_bucket, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(int(found["key"].max()) + 1, np.int64)
    count[found["key"].to_numpy()] = found["n"].to_numpy()
    parts = _distance_parts(count, width, slots)

    dense = np.issubdtype(labels.dtype, np.integer) and int(gaps[-1]) < 1 << 22
    if dense:
        weight = np.zeros(int(gaps[-1]) + 1)
        weight[gaps] = gap_rank - mean
        labels = (labels - labels.min()).astype(np.int8 if gaps[-1] < 128 else np.int32)

    def within(low, high):
        """i, j and the distance in units of the pairs in a range: single precision with its error finds them, double tells."""
        exact = {first: block.value for first, block in blocks}
        rough = {first: v.astype(np.float32) for first, v in exact.items()}
        across = {first: np.ascontiguousarray(v.T) for first, v in rough.items()}
        slack = (2 + len(across[0])) * 2.0**-22
        near, far = (np.float32(np.inf) if low <= 0 else np.float32(1 - low / units + slack)), np.float32(1 - high / units - slack)
        room, one, two = np.empty(4 * side * side, np.float32), np.empty(4 * side * side, bool), np.empty(4 * side * side, bool)
        for first, a, other, c in corners():
            top, right = rough[first][a : a + side], across[other][:, c : c + 4 * side]
            shape, size = (len(top), right.shape[1]), len(top) * right.shape[1]
            s = np.matmul(top, right, out=room[:size].reshape(shape))
            no_others(s, first, a, other, c)
            np.less_equal(room[:size], near, out=one[:size])
            np.greater_equal(room[:size], far, out=two[:size])
            k = np.flatnonzero(np.logical_and(one[:size], two[:size], out=one[:size]))
            v, w = exact[first][a : a + side], exact[other][c : c + 4 * side]
            whole = (v @ w.T).ravel() if len(k) > size // 16 else None  # cheaper than rows one by one
            for p in range(0, len(k), 2048):
                i, j = np.divmod(k[p : p + 2048], shape[1])
                d = in_units(np.einsum("ij,ij->i", v.take(i, 0), w.take(j, 0)) if whole is None else whole.take(k[p : p + 2048]))
                inside = (d >= low) & (d < high)
                yield i[inside] + (first + a), j[inside] + (other + c), d[inside]

    def sums(out, orders, i, j, rank):
        """Adds the squares of these pairs' centred ranks, and their products with the gaps' under each order of the labels."""
        r = rank - mean
        out[0] += r @ r
        for k in range(0, len(r), 2048):
            g = np.abs(orders.take(i[k : k + 2048], 0) - orders.take(j[k : k + 2048], 0))
            out[1:] += r[k : k + 2048] @ (weight.take(g) if dense else gap_rank[np.searchsorted(gaps, g)] - mean)

    def ranked(batches):
        rng = np.random.default_rng(seed)
        orders = np.stack([labels, *(labels[rng.permutation(n)] for _ in range(permutations))], axis=1)
        for b in batches:
            for at_ in b.column("id").to_pylist():
                low, high, start, pairs = parts[at_]
                out = np.zeros(permutations + 2)
                if pairs <= heavy:
                    held = [(i.astype(np.int32), j.astype(np.int32), d) for i, j, d in within(low, high)]
                    i, j, d = (np.concatenate(x) for x in zip(*held, strict=True)) if held else np.zeros((3, 0), np.int64)
                    _, place, times = np.unique(d, return_inverse=True, return_counts=True)
                    sums(out, orders, i, j, (start + np.cumsum(times) - times + (times + 1) / 2)[place])
                else:
                    # One place before the range, so that each count has the sum of those before it.
                    upto = np.zeros(high - low + 1, np.uint32 if pairs < 1 << 32 else np.int64)
                    one = upto.dtype.type(1)
                    for _, _, d in within(low, high):
                        np.add.at(upto, d - (low - 1), one)
                    np.cumsum(upto, out=upto)
                    for i, j, d in within(low, high):
                        before, last = upto[d - low].astype(np.int64), upto[d - (low - 1)].astype(np.int64)
                        sums(out, orders, i, j, start + (before + last + 1) / 2)
                yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["sums"])

    each = spark.range(0, len(parts), 1, len(parts)).mapInArrow(ranked, "sums array<double>").toPandas()["sums"]
    parts_sum = np.stack(each.to_numpy()).sum(0)
    for _, block in blocks:
        block.destroy()
    spread = np.sqrt(parts_sum[0]) * np.sqrt(float(gap_counts @ (gap_rank - mean) ** 2))
    corr = parts_sum[1:] / spread if spread > 0 else np.full(permutations + 1, np.nan)
    more = int((np.abs(corr[1:]) >= abs(corr[0]) - 1e-12).sum())
    return spark.createDataFrame([(float(corr[0]), (more + 1) / (permutations + 1))], kind)


#: Distances of one tile within a label's task.
DBCV_TILE = 1 << 19


@embedding_metrics.register("dbcv")
def dbcv(rows: DataFrame) -> DataFrame:
    """Density-based validity by cosine distance (EM-11).

    For each label: core distances, a least spanning tree of mutual
    reachability, its inner nodes (more than one edge) and its widest edge
    between them. Between labels: the least mutual reachability of inner nodes.
    A label without inner nodes takes all its nodes and edges; edges as wide as
    each other, of which there are many, go by their distance; with one label alone there is no value.

    A tree needs a label's rows together, but no matrix of them: distances are
    worked out a tile or a row at a time, so memory grows with a label's rows,
    and a task's time with their square.
    """
    import numpy as np
    import pandas as pd

    def apart(v, w):
        return np.maximum(1 - v @ w.T, 0)

    def cores(v):
        """The mean of the distances to all others to the power -dim, to the power -1/dim, in logarithms, since that overflows for many dimensions."""
        n, dim = v.shape
        core, step = np.zeros(n), max(1, DBCV_TILE // n)
        for k in range(0, n, step):
            d = apart(v[k : k + step], v)
            d[np.arange(len(d)), np.arange(k, k + len(d))] = 0
            far = np.where(d > 1e-12, -dim * np.log(np.maximum(d, 1e-12)), -np.inf)
            top = np.maximum(far.max(1, keepdims=True), -1e300)
            core[k : k + step] = np.exp(-(np.log(np.maximum(np.exp(far - top).sum(1) / max(n - 1, 1), 1e-300)) + top[:, 0]) / dim)
            core[k : k + step][~np.isfinite(far).any(1)] = 0
        return core

    def spanning(v, core):
        """The edges (i, j, width) of a least spanning tree by Prim. Of the nodes still out only rows count; they are packed anew now and then."""
        n = len(v)
        out, w, c = np.arange(1, n), v[1:], core[1:]
        then = apart(v[:1], w)[0]
        best, parent, edges = np.maximum(then, np.maximum(core[0], c)), np.zeros(n - 1, int), []
        left, wide = n - 1, best.copy()
        while left:
            low = np.flatnonzero(wide == wide.min())
            k = int(low[then[low].argmin()])
            node = int(out[k])
            edges.append((int(parent[k]), node, float(best[k])))
            wide[k], left = np.inf, left - 1
            if left < 0.8 * len(out):
                keep = np.isfinite(wide)
                out, w, c, then, best, parent, wide = (x[keep] for x in (out, w, c, then, best, parent, wide))
            d = apart(v[node : node + 1], w)[0]
            m = np.maximum(np.maximum(d, c), core[node])
            nearer = np.flatnonzero(((m < best) | ((m == best) & (d < then))) & np.isfinite(wide))
            parent[nearer], then[nearer], best[nearer], wide[nearer] = node, d[nearer], m[nearer], m[nearer]
        return edges

    def tree(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        v = np.stack(p["v"].to_numpy())
        n = len(v)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), EPS)
        core = cores(v)
        edges = spanning(v, core)
        degree = np.bincount([x for a, b, _ in edges for x in (a, b)], minlength=n)
        inner = degree > 1 if (degree > 1).any() else np.ones(n, bool)
        widths = [w for a, b, w in edges if inner[a] and inner[b]] or [w for _, _, w in edges] or [0.0]
        return pd.DataFrame({"label": p["label"].iloc[0], "v": list(v[inner]), "core": core[inner], "n": n, "sparse": max(widths)})

    def nearest(p: pd.DataFrame) -> pd.DataFrame:
        one = p["label"].to_numpy() == p["a"].iloc[0]
        v, core = np.stack(p["v"].to_numpy()), p["core"].to_numpy()
        least = np.inf
        (ours, our_core), (theirs, their_core) = (v[one], core[one]), (v[~one], core[~one])
        step = max(1, DBCV_TILE // max(1, len(theirs)))
        for k in range(0, len(ours), step):  # a tile at a time: no matrix of two labels is held
            least = min(least, float(np.maximum(np.maximum(apart(ours[k : k + step], theirs), their_core), our_core[k : k + step, None]).min()))
        return pd.DataFrame({"a": p["a"].iloc[:1], "b": p["b"].iloc[:1], "gap": [least]})

    from lectern.sources.stage import stored

    nodes = stored(rows.where(F.col("label").isNotNull()).groupBy("label").applyInPandas(tree, "label long, v array<double>, core double, n long, sparse double"), "trees")
    labels = nodes.groupBy("label").agg(F.max("n").alias("n"), F.max("sparse").alias("sparse"))
    names = F.array(*[F.lit(r[0]) for r in labels.select("label").orderBy("label").collect()]).cast("array<bigint>")  # labels, not rows
    met = nodes.select("label", "v", "core", F.explode(names).alias("other")).where("label <> other").withColumns({"a": F.least("label", "other"), "b": F.greatest("label", "other")})
    gaps = met.groupBy("a", "b").applyInPandas(nearest, "a long, b long, gap double")
    gap = gaps.select(F.explode(F.array("a", "b")).alias("label"), "gap").groupBy("label").agg(F.min("gap").alias("gap"))
    each = labels.join(gap, "label")
    return each.agg((F.sum(F.col("n") * (F.col("gap") - F.col("sparse")) / F.greatest("gap", "sparse")) / F.sum("n")).alias("dbcv"))


def pca(df: DataFrame, vector: str, k: int, name: str = "pca") -> DataFrame:
    """Centred projection on the first k principal components (EM-13, EM-14)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.withColumn("_x", array_to_vector(doubles(F.col(vector))))
    x = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(x).transform(x)
    x = PCA(k=k, inputCol="_c", outputCol="_p").fit(x).transform(x)
    return x.withColumn(name, vector_to_array("_p")).drop("_x", "_c", "_p")


@embedding_metrics.register("ridge")
def ridge(rows: DataFrame, alpha: float = 1.0, folds: int = 5) -> DataFrame:
    """Mean R² and absolute error of ridge regression over contiguous folds by id order (EM-7)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    from lectern.sources.stage import numbered, stored

    n = rows.count()
    size, extra = divmod(n, folds)
    at = numbered(rows.select("id", F.col("label").cast("double").alias("y"), "v"), "id")
    wide = extra * (size + 1)
    fold = F.when(F.col("number") < wide, F.floor(F.col("number") / (size + 1))).otherwise(extra + F.floor((F.col("number") - wide) / max(size, 1)))
    data = stored(at.select("y", fold.cast("int").alias("fold"), F.col("v")), "folds").withColumn("x", array_to_vector("v")).cache()
    r2, mae = [], []
    for k in range(folds):
        train, test = data.where(F.col("fold") != k), data.where(F.col("fold") == k)
        m, sd = train.agg(F.count("*"), F.stddev_pop("y")).first()
        model = LinearRegression(featuresCol="x", labelCol="y", regParam=alpha * sd / m, elasticNetParam=0.0, standardization=False, solver="normal").fit(train)
        p = model.transform(test)
        mean = test.agg(F.avg("y")).first()[0]
        e = p.agg(F.sum((F.col("y") - F.col("prediction")) ** 2), F.avg(F.abs(F.col("y") - F.col("prediction"))), F.sum((F.col("y") - mean) ** 2)).first()
        r2.append(1 - e[0] / e[2])
        mae.append(e[1])
    data.unpersist()
    return rows.sparkSession.createDataFrame([(sum(r2) / folds, sum(mae) / folds)], "ridge_r2 double, ridge_mae double")


def logit_importance(df: DataFrame, features: list[str], target: Column, c: float = 1.0) -> DataFrame:
    """feature and coefficient of a logistic regression on imputed, standardised columns (EM-16)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    x = df.select(*[F.col(f).cast("double").alias(f) for f in features], target.cast("double").alias("_y"))
    n = x.count()
    steps = [
        Imputer(strategy="median", inputCols=features, outputCols=[f"_{f}" for f in features]), VectorAssembler(inputCols=[f"_{f}" for f in features], outputCol="_a"),
        StandardScaler(inputCol="_a", outputCol="_s", withMean=True), LogisticRegression(featuresCol="_s", labelCol="_y", regParam=1 / (c * max(n, 1)), standardization=False),
    ]
    model = Pipeline(stages=steps).fit(x).stages[-1]
    return df.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, model.coefficients, strict=True)], "feature string, coefficient double")


def dense_labels(df: DataFrame, label: str, name: str = "label_id") -> DataFrame:
    """Ids from 0 in the order of the distinct labels (EM-17)."""
    from lectern.sources.stage import numbered

    return df.join(numbered(df.select(label).where(F.col(label).isNotNull()).distinct(), label, name=name), label)


def year_bins(year: Column, newest: Column, width: int = 30) -> Column:
    """0 for the newest years, counting down in bins (EM-18)."""
    return F.floor((newest - year) / width).cast("int")


def all_metrics(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row with the columns of all named metrics."""
    out = None
    for n in names:
        m = embedding_metrics.get(n)(rows)
        out = m if out is None else out.crossJoin(m)  # one row each
    return out
