"""Properties of the operators: chunks slice back to their text, metrics stay in range, plans have the shape they should."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern import models as M
from lectern.operators import chunkers as C
from lectern.operators import prepare as P
from lectern.operators import reports as R
from lectern.operators import retrieval as Q
from lectern.operators import splits as S
from lectern.registry import chunkers
from lectern.sources.stage import numbered

TEXT = st.text(alphabet="abc éD.!?\n ,;", max_size=400)
PARAMS = {
    "fixed_size": {"chunk_size": 40, "overlap": 10}, "recursive": {"chunk_size": 40, "min_characters_per_chunk": 5}, "semantic": {"chunk_size": 20}, "neural": {}, "max_min": {"hard_threshold": 0.3},
    "sequential_hac": {"distance_threshold": 0.5}, "recursive_semantic": {"max_chunk_size": 200, "recursive_threshold": 80, "final_threshold": 90, "merge_threshold": 20, "delta": 20},
    "lumber": {"group_size_threshold": 20}, "packed_sentences": {"most": 50},
}


@pytest.mark.parametrize("method", sorted(PARAMS))
@settings(max_examples=40, deadline=None)
@given(text=TEXT)
def test_chunks_slice_back_in_order(method, text):
    last = -1
    for s, a, b in C.spans_of(text, method, **PARAMS[method]):
        assert text[a : b + 1] == s and s == s.strip() and s
        assert a >= last if method == "fixed_size" else a > last
        last = a if method == "fixed_size" else b


@settings(max_examples=60, deadline=None)
@given(text=TEXT)
def test_recursive_chunks_fit(text):
    assert all(b - a <= 40 for a, b in C.recursive(text, 40, 5))
    assert "".join(text[a:b] for a, b in C.recursive(text, 40, 5)) == text


def test_chunker_errors():
    with pytest.raises(ValueError):
        C.fixed_size("x", 10, 10)
    with pytest.raises(ValueError):
        C.recursive("x", 10, 10)
    with pytest.raises(ValueError, match="no chunker named"):
        chunkers.get("nothing of the kind")
    assert C.neural("abc", split=lambda t: 1 / 0) == [(0, 3)]


def test_knn_against_brute_force_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)).round(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vector array<double>")
    monkeypatch.setattr(Q, "BLOCK_BYTES", 400)
    got = Q.knn_global(rows.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "qid"), rows, 7).collect()
    for q in range(0, 60, 3):
        want = sorted((round(float(((x[q] - x[i]) ** 2).sum()), 9), i) for i in range(60) if i != q)[:7]
        assert [r.chunk_id for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] == [i for _, i in want]


def test_knn_with_few_or_no_rows(spark):
    rows = spark.createDataFrame([(1, [0.0]), (2, [1.0])], "chunk_id long, vector array<double>")
    q = rows.withColumnRenamed("chunk_id", "qid")
    assert Q.knn_global(q, rows, 10).count() == 2
    assert Q.knn_global(q.limit(0), rows, 10).count() == 0


def test_metrics_of_questions_without_results_are_zero(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, book string")
    found = spark.createDataFrame([(1, 2, True), (1, 1, False)], "qid long, rank int, is_good boolean")
    rel = spark.createDataFrame([("a", 4)], "book string, total_relevant long")
    m = {r.qid: r for r in Q.ir_metrics(found, q, rel).collect()}
    assert m[1].mrr == 0.5 and m[1].recall == 0.25 and m[1].accuracy_at_1 == 0 and m[1].accuracy_at_2 == 1
    assert m[2].ndcg == 0 and m[2].recall == 0
    assert Q.mean_metrics(Q.ir_metrics(found, q.limit(0), rel)).first().mrr == 0


@pytest.mark.parametrize("tokens,kept", [([200, 1], 0), ([60, 60, 1], 2), ([90, 40, 5], 1), ([0, 120], 2)])
def test_budget_stops_at_the_first_that_does_not_fit(spark, tokens, kept):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(tokens)], "qid long, rank int, tokens_len int")
    assert Q.within_budget(rows, 120).count() == kept


def test_budget_and_topk_plans(spark):
    rows = spark.createDataFrame([(1, 2, 0.5)], "qid long, chunk_id long, distance double")
    plan = Q.ranked(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan


def test_numbers_are_dense_and_ordered(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r.number for r in numbered(rows, "k").collect())


def test_split_counts(spark):
    b = P.split_assigned(spark.range(101).toDF("b"), "b")
    n = {r[0]: r[1] for r in b.groupBy("split").count().collect()}
    assert n == {"test": 20, "validation": 10, "train": 71}
    assert b.where("example").count() == 1 and b.where("examples").count() == 3


def test_tags_and_chunks(spark):
    c = spark.createDataFrame([("b", 0, 0, 9), ("b", 1, 12, 19), ("b", 2, 20, 9000), ("b", 3, 9001, 9002)], "book string, chunk_id int, start_index int, end_index int")
    t = [("b", 1, "p", 1, 5), ("b", 2, "p", 8, 15), ("b", 3, "p", 10, 11), ("b", 4, "p", 11, 19), ("b", 5, "div", 0, 1), ("b", 6, "h1", 20, 9000)]
    t = spark.createDataFrame(t, "book string, tag_id int, tag_name string, tag_start int, tag_end int")
    spans = {r.tag_id: (r.n_chunks, r.inside) for r in S.tag_spans(c, t).collect()}
    assert spans == {1: (1, True), 2: (2, False), 4: (1, False), 6: (1, True)}
    edges = {r.chunk_id: (r.good_start, r.good_end) for r in S.edges(c, t).collect()}
    assert edges == {0: (False, True), 1: (True, True), 2: (True, True), 3: (False, False)}
    assert [r.chunk_id for r in S.orphans(c, t).collect()] == [3]


def test_many_to_one_and_strict_joins_fail_loudly(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="repeat"):
        R.many_to_one(a, b, ["k"]).collect()
    with pytest.raises(Exception, match="no partner"):
        R.strictly_joined(a, b, ["k"], "v").collect()


@pytest.mark.parametrize("heavy", [1 << 22, 500])
def test_mantel_takes_all_pairs_of_more_than_2000_rows(spark, monkeypatch, heavy):
    import numpy as np
    import pandas as pd

    from lectern.operators import clustering

    monkeypatch.setattr(clustering, "HEAVY_PAIRS", heavy)
    monkeypatch.setattr(clustering, "PART_PAIRS", 100_000)
    monkeypatch.setattr(clustering, "MANTEL_BYTES", 8 * 4 * 1500)
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2300, 4)), rng.integers(0, 12, 2300)
    x[:100] = x[0]
    x[:, 0] += y / 6
    i, j = np.triu_indices(len(x), 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rank = lambda a: pd.Series(a).rank().to_numpy()
    want = np.corrcoef(rank(np.round(1 - (u[i] * u[j]).sum(1), 9)), rank(np.abs(y[i] - y[j])))[0, 1]
    rows = spark.createDataFrame([(k, int(b), a.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))], "id long, label long, v array<double>").repartition(3)
    got = clustering.mantel(rows, permutations=4).first()
    assert got.mantel_corr == pytest.approx(want, abs=1e-9) and got.mantel_p_value == 0.2
    assert clustering.mantel(rows.limit(2)).first().mantel_corr is None


@pytest.mark.parametrize("units", [1 << 26, 1 << 22])
def test_mantel_writes_no_pairs(spark, monkeypatch, units):
    """Two million pairs, most with equals, in tables: the same as by brute force, and less disk than two bytes a pair."""
    import numpy as np
    import pandas as pd

    from lectern.operators import clustering

    monkeypatch.setattr(clustering, "HEAVY_PAIRS", 20_000)
    monkeypatch.setattr(clustering, "TABLE_UNITS", units, raising=False)
    monkeypatch.setattr(clustering, "BUCKETS", 1 << 12)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(500, 3)), 4, 0)
    y = rng.integers(-3, 4, len(x)) / (1 if units == 1 << 26 else 2)  # labels that aren't whole numbers, too
    i, j = np.triu_indices(len(x), 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rank = lambda a: pd.Series(a).rank().to_numpy()
    want = np.corrcoef(rank(np.round(1 - (u[i] * u[j]).sum(1), 9)), rank(np.abs(y[i] - y[j])))[0, 1]
    kind = "long" if units == 1 << 26 else "double"
    rows = spark.createDataFrame([(k, b, a.tolist()) for k, (a, b) in enumerate(zip(x, y.astype(int).tolist() if kind == "long" else y.tolist(), strict=True))], f"id long, label {kind}, v array<double>")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    used = lambda: sum(f.apply(k).length() for f in [disk.getAllFiles()] for k in range(f.size()))
    before = used()
    got = clustering.mantel(rows, permutations=2).first()
    assert got.mantel_corr == pytest.approx(want, abs=1e-9)
    assert used() - before < 2 * len(i)


def test_dbcv_against_its_definition(spark):
    import numpy as np

    from lectern.operators import clustering

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 5))
    data = [(i, i % 4, (centres[i % 4] + 0.4 * rng.normal(size=5)).tolist()) for i in range(90)] + [(100, 7, [1.0, 0.0, 0.0, 0.0, 0.0]), (101, 7, [0.9, 0.1, 0.0, 0.0, 0.2])]
    got = clustering.dbcv(spark.createDataFrame(data, "id long, label long, v array<double>")).first()[0]

    distance = lambda x, y: 1 - np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y))
    labels = sorted({g for _, g, _ in data})
    points = {g: [np.array(v) for _, h, v in data if h == g] for g in labels}
    core = {g: [np.mean([distance(x, y) ** -5.0 for j, y in enumerate(ps) if j != i]) ** (-1 / 5) for i, x in enumerate(ps)] for g, ps in points.items()}
    inner, sparse = {}, {}
    for g, ps in points.items():
        n, root, degree, edges = len(ps), list(range(len(ps))), [0] * len(ps), []
        for w, _, i, j in sorted((max(distance(ps[i], ps[j]), core[g][i], core[g][j]), distance(ps[i], ps[j]), i, j) for i in range(n) for j in range(i)):
            if root[i] != root[j]:
                root = [root[i] if r == root[j] else r for r in root]
                edges.append((w, i, j))
                degree[i] += 1
                degree[j] += 1
        inner[g] = [i for i in range(n) if degree[i] > 1] or list(range(n))
        sparse[g] = max([w for w, i, j in edges if degree[i] > 1 and degree[j] > 1] or [w for w, _, _ in edges])
    want = 0
    for g in labels:
        gap = min(max(distance(points[g][i], points[h][j]), core[g][i], core[h][j]) for h in labels if h != g for i in inner[g] for j in inner[h])
        want += len(points[g]) / len(data) * (gap - sparse[g]) / max(gap, sparse[g])
    assert abs(got - want) < 1e-6


def test_dbcv_of_a_label_of_more_than_5000_rows(spark, monkeypatch):
    """Two labels, one of 5,200 rows: the value that whole matrices give."""
    import numpy as np

    from lectern.operators import clustering

    monkeypatch.setattr(clustering, "DBCV_TILE", 5200 * 300, raising=False)
    rng = np.random.default_rng(8)
    x = np.concatenate([[3, 0, 0] + rng.normal(size=(5200, 3)), [0, 3, 0] + rng.normal(size=(40, 3))])
    label = np.repeat([0, 1], [5200, 40])
    got = clustering.dbcv(spark.createDataFrame([(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(label, x, strict=True))], "id long, label long, v array<double>")).first()[0]

    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    inner, core, sparse, n = {}, {}, {}, {}
    for g in (0, 1):
        v = u[label == g]
        n[g] = len(v)
        d = np.maximum(1 - v @ v.T, 0)
        np.fill_diagonal(d, np.inf)
        core[g] = (np.where(d > 1e-12, d, np.inf) ** -3.0).sum(1)
        core[g] = (core[g] / (len(v) - 1)) ** (-1 / 3)
        m = np.maximum(d, np.maximum(core[g][:, None], core[g][None]))
        best, then, parent, left, edges = m[0].copy(), d[0].copy(), np.zeros(len(v), int), np.arange(len(v)) > 0, []
        for _ in range(len(v) - 1):
            wide = np.where(left, best, np.inf)
            k = int(np.where(wide == wide.min(), then, np.inf).argmin())
            edges.append((parent[k], k, best[k]))
            left[k] = False
            nearer = left & ((m[k] < best) | ((m[k] == best) & (d[k] < then)))
            parent[nearer], best[nearer], then[nearer] = k, m[k][nearer], d[k][nearer]
        degree = np.bincount([x for a, b, _ in edges for x in (a, b)], minlength=len(v))
        inner[g], sparse[g] = degree > 1, max(w for a, b, w in edges if degree[a] > 1 and degree[b] > 1)
        inner[g] = (v[inner[g]], core[g][inner[g]])
    gap = np.maximum(np.maximum(1 - inner[0][0] @ inner[1][0].T, inner[0][1][:, None]), inner[1][1][None]).min()
    want = sum(n[g] * (gap - sparse[g]) / max(gap, sparse[g]) for g in (0, 1)) / len(x)
    assert abs(got - want) < 1e-9


def test_vector_search_is_the_same_in_small_matrices(spark, monkeypatch):
    import numpy as np

    from lectern.operators import retrieval

    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 4)).round(1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<double>").repartition(3)
    queries = rows.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "qid")
    monkeypatch.setattr(retrieval, "MATRIX_BYTES", 8 * 40 * 7)  # seven rows at once
    got = {(r.qid, r["rank"]): r.chunk_id for r in retrieval.knn_global(queries, rows, 5).collect()}
    for q in range(0, 120, 3):
        near = sorted((round(float(((v[q] - v[i]) ** 2).sum()), 9), i) for i in range(120) if i != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [i for _, i in near]


def test_vector_search_takes_no_vector_to_the_driver(spark, monkeypatch):
    """Many equal vectors and equal distances, in many small blocks: as by brute force, with no vectors collected."""
    import numpy as np
    from pyspark.sql import DataFrame

    rng = np.random.default_rng(6)
    v = np.concatenate([np.tile(rng.normal(size=(1, 3)), (150, 1)), rng.integers(-1, 2, (150, 3)) * 1000.0, rng.normal(size=(100, 3))])
    ids = rng.permutation(1000)[: len(v)]
    rows = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "chunk_id long, vector array<double>").repartition(3)
    monkeypatch.setattr(Q, "BLOCK_BYTES", 24 * 30)
    monkeypatch.setattr(Q, "MATRIX_BYTES", 4 * 64 * 20)
    monkeypatch.setattr(Q, "TASK_BYTES", 24 * 30 * 5, raising=False)
    monkeypatch.setattr(DataFrame, "toArrow", None)
    got = {(r.qid, r["rank"]): (r.distance, r.chunk_id) for r in Q.knn_global(rows.withColumnRenamed("chunk_id", "qid"), rows, 5).collect()}
    assert len(got) == 5 * len(v)
    for q, x in zip(ids, v, strict=True):
        d = ((v - x) ** 2).cumsum(1)[:, -1]
        want = sorted((round(float(a), 9), int(i)) for a, i in zip(d, ids, strict=True) if i != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == want


def test_the_model_not_asked_for_longest_goes():
    M.clear_models()
    made = []
    ask = lambda k: M.cached(k, lambda: made.append(k) or k, most=2)
    assert [ask(k) for k in "abacab"] == list("abacab")
    assert made == ["a", "b", "c", "b"]
    M.clear_models()


def test_pair_scorer_is_the_overlap(spark):
    rows = [("One two", "two three"), ("", "x"), (None, "x"), ("a", None), ("Éa b-c", "éa, c"), ("a a", "a")]
    df = spark.createDataFrame(rows, "q string, t string").withColumn("plain", M.overlap_score(F.col("q"), F.col("t")))
    got = M.pair_scored(df, "q", "t", batch=2).collect()
    assert [r.score for r in got] == pytest.approx([0.5, 0, 0, 0, 2 / 3, 1]) and [r.plain for r in got] == pytest.approx([r.score for r in got])


def test_every_old_id_has_its_new_one(spark):
    books = spark.createDataFrame([(7, "x"), (3, "y"), (5, "x"), (None, "x"), (9, None)], "id long, body string")
    groups = P.dedup(books, [F.col("body")], "id")
    got = {r.old_id: r.new_id for r in P.old_to_new(books, [F.col("body")], "id", groups).collect()}
    assert got == {3: 0, 5: 1, 7: 1, 9: 2}


def test_chunks_of_a_large_batch_come_in_small_ones(spark, monkeypatch):
    """A batch of very many texts gives its chunks as it goes, not all at its end."""
    texts = spark.range(900).selectExpr("id as source_file", "concat('One two. ', repeat('Three four five! ', 40), id) as text").coalesce(1)
    monkeypatch.setattr(C, "CHUNKED_BYTES", 5000, raising=False)
    df = C.chunked(texts, "fixed_size", {"chunk_size": 100})
    sizes = [b.num_rows for b in C.chunk_batches("fixed_size", {"chunk_size": 100}, "source_file")(iter(texts.toArrow().to_batches()))]
    assert len(sizes) > 50 and max(sizes) < 100
    rows = df.collect()
    want = [(k, i, a, b, s) for k in range(900) for i, (s, a, b) in enumerate(C.spans_of("One two. " + "Three four five! " * 40 + str(k), "fixed_size", chunk_size=100))]
    assert sum(sizes) == len(want) and sorted((r.source_file, r.chunk_no, r.start_index, r.end_index, r.text) for r in rows) == want


def test_remembered_and_hashed_vectors_are_the_models(spark):
    import re
    import zlib

    import numpy as np

    texts = ["a b a C", "", "naïve Ünïcode_9 ٣", "a b a C", "x " * 500]
    want = np.zeros((len(texts), 64), np.float32)
    for k, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            want[k, h % 64] += 1 if h & 0x80000000 else -1
    n = np.linalg.norm(want, axis=1, keepdims=True)
    model = M.HashingEmbedder()
    model.most = 2  # the kept words go now and then
    once = M.Remembering(model)
    for _ in range(2):
        assert (once.encode(texts) == want / np.where(n > 0, n, 1)).all()
    asked = []
    once.model = type("Counting", (), {"encode": lambda self, x: asked.extend(x) or model.encode(x)})()
    once.encode([*texts, "new", "new"])
    assert asked == ["new"]


def test_joined_spans_are_not_embedded_anew(monkeypatch):
    """A text of many short sentences: the spans of whole embeddings, from a number of characters in proportion to it."""
    text = "".join(("alpha beta. ", "gamma Ä9.", "eps zeta! ?", "eta_1 theta... ")[k % 4] for k in range(1000))
    seen = []
    whole = M.HashingEmbedder.encode

    class Plain:
        def encode(self, texts):
            seen.extend(map(len, texts))
            return whole(M.HashingEmbedder(), texts)

    monkeypatch.setattr(C, "_model", lambda name: Plain())
    want = C.recursive_semantic(text)
    slow = sum(seen)

    class Counted(M.HashingEmbedder):
        def counts(self, texts):
            seen.extend(map(len, texts))
            return super().counts(texts)

    seen.clear()
    monkeypatch.setattr(C, "_model", lambda name: Counted())
    assert C.recursive_semantic(text) == want
    assert sum(seen) < 4 * len(text) and slow > 3 * sum(seen), (sum(seen), len(text), slow)
