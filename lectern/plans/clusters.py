"""Queries over the embedding-space metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import clustering as C
from lectern.plans.catalog import query
from lectern.plans.retrieval import table


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prepared(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")


def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = F.when(F.col("vec_id") % 3 == 0, F.array(F.col("label"), (F.col("label") + 1) % 10)).otherwise(F.array("label"))
    return C.members(table(spark, sf_dir, "embeddings"), "vec_id", two, "embedding")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_E = "e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT id, label, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM e)"
_C = f"{_E}, c AS (SELECT label, list(m ORDER BY p) AS c, max(n) AS n FROM (SELECT label, p, avg(x) AS m, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1)"
_U = "u AS (SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
_PAIRS = f"{_U}, pairs AS (SELECT a.id, a.label, b.label AS other, b.id AS other_id, list_dot_product(a.v, b.v) AS cos FROM u a JOIN u b ON a.id <> b.id)"


@query("em01_calinski_harabasz", f"WITH {_C}, g AS (SELECT list(m ORDER BY p) AS g FROM (SELECT p, avg(x) AS m FROM x GROUP BY 1)), b AS (SELECT sum(n * list_distance(c, g) ** 2) AS b, count(*) AS k FROM c, g), w AS (SELECT sum(list_distance(v, c) ** 2) AS w, count(*) AS n FROM e JOIN c USING (label)) SELECT round(b * (w.n - k) / (w * (k - 1)), 6) AS calinski_harabasz FROM b, w")
def em01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.calinski_harabasz(rows(spark, sf_dir)))


@query("em02_davies_bouldin", f"WITH {_C}, s AS (SELECT label, avg(list_distance(v, c)) AS s FROM e JOIN c USING (label) GROUP BY 1), r AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r FROM c a JOIN c b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def em02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.davies_bouldin(rows(spark, sf_dir)))


@query("em03_silhouette_cosine", f"WITH {_PAIRS}, m AS (SELECT id, label, other, avg(1 - cos) AS d FROM pairs GROUP BY 1, 2, 3), s AS (SELECT id, max(CASE WHEN label = other THEN d END) AS a, min(CASE WHEN label <> other THEN d END) AS b FROM m GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s")
def em03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.silhouette(rows(spark, sf_dir)))


@query("em04_inter_intra", f"WITH {_PAIRS}, s AS (SELECT avg(CASE WHEN label <> other THEN cos END) AS inter, avg(CASE WHEN label = other THEN cos END) AS intra FROM pairs) SELECT round(inter, 6) AS inter, round(intra, 6) AS intra, round(intra - inter, 6) AS separation, round(intra / (inter + 1e-8), 3) AS ratio, (SELECT count(*) FROM u) AS n_used FROM s")
def em04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.inter_intra(rows(spark, sf_dir)).withColumn("ratio", F.round("ratio", 3)))


@query("em05_knn_consistency", f"WITH {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(2 - 2 * cos, 9), other_id) AS r FROM pairs), g AS (SELECT id, avg(abs(label - other)) AS g FROM k WHERE r <= 10 GROUP BY 1) SELECT round(avg(g), 4) AS knn_temporal_consistency FROM g")
def em05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.knn_consistency(rows(spark, sf_dir)), 4)


@query("em06_mantel_corr", f"WITH {_PAIRS}, d AS (SELECT round(1 - cos, 9) AS d, abs(label - other) AS g FROM pairs WHERE id < other_id), r AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS rd, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rg FROM d) SELECT round(corr(rd, rg), 5) AS mantel_corr FROM r")
def em06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.mantel(rows(spark, sf_dir), permutations=19).select("mantel_corr"), 5)


@query("em06_mantel_p_value")
def em06p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mantel(rows(spark, sf_dir), permutations=49)


_M = """m AS (SELECT vec_id AS id, unnest(CASE WHEN vec_id % 3 = 0 THEN [label, (label + 1) % 10] ELSE [label] END) AS label, CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS u, embedding::DOUBLE[] AS v FROM embeddings),
mx AS (SELECT label, u * u AS w, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM m), c AS (SELECT label, list(m ORDER BY p) AS c FROM (SELECT label, p, sum(w * x) / (sum(w) + 1e-12) AS m FROM mx GROUP BY 1, 2) GROUP BY 1),
near AS (SELECT min(1 - list_cosine_similarity(a.c, b.c)) AS near FROM c a JOIN c b ON a.label <> b.label)"""


@query("em08_fuzzy_dunn", f"WITH {_M}, s AS (SELECT m.label, sum(u * u * (1 - list_cosine_similarity(v, c))) / (sum(u * u) + 1e-12) AS s FROM m JOIN c USING (label) GROUP BY 1) SELECT round(min(near) / (max(s) + 1e-12), 6) AS soft_fuzzy_dunn FROM s, near")
def em08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.fuzzy_dunn(fuzzy(spark, sf_dir)))


@query(
    "em09_fuzzy_silhouette",
    f"WITH {_M}, t AS (SELECT id, min(label) FILTER (WHERE u = mu) AS own, any_value(v) AS v, CASE WHEN count(*) > 1 THEN 0 ELSE 1 END AS w FROM (SELECT *, max(u) OVER (PARTITION BY id) AS mu FROM m) GROUP BY 1), "
    "d AS (SELECT id, any_value(w) AS w, max(CASE WHEN label = own THEN 1 - list_cosine_similarity(v, c) END) AS a, min(CASE WHEN label <> own THEN 1 - list_cosine_similarity(v, c) END) AS b FROM t, c GROUP BY 1) SELECT round(sum(w * (b - a) / (greatest(a, b) + 1e-12)) / (sum(w) + 1e-12), 6) AS soft_fuzzy_silhouette FROM d",
)
def em09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.fuzzy_silhouette(fuzzy(spark, sf_dir)))


@query("em10_xie_beni", f"WITH {_M} SELECT round(sum(u * u * (1 - list_cosine_similarity(v, c)) ** 2) / (count(DISTINCT id) * max(near) ** 2 + 1e-12), 4) AS xie_beni_index FROM m JOIN c USING (label), near")
def em10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.xie_beni(fuzzy(spark, sf_dir)), 4)


@query("em12_memberships", "WITH m AS (SELECT vec_id AS id, unnest(CASE WHEN vec_id % 3 = 0 THEN [label, (label + 1) % 10] ELSE [label] END) AS label, CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS u FROM embeddings) SELECT id, label, u::DOUBLE AS u FROM m")
def em12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy(spark, sf_dir).select("id", "label", "u")


@query("em07_ridge_cv")
def em07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.ridge(rows(spark, sf_dir))


@query("em11_dbcv")
def em11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dbcv(rows(spark, sf_dir))


@query("em13_14_pca")
def em13(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.pca(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 2)
    return p.select("vec_id", F.round(F.abs(F.get("pca", F.lit(0))), 6).alias("pc1_abs"), F.round(F.abs(F.get("pca", F.lit(1))), 6).alias("pc2_abs"))


@query("em16_logit_importance")
def em16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.logit_importance(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], F.col("p_partkey") % 3 == 0)


@query("em17_dense_labels", "SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS label_id FROM documents")
def em17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dense_labels(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", F.col("label_id").cast("long").alias("label_id"))


@query("em18_year_bins", "SELECT event_id, floor((2020 - (1800 + event_id % 221)) / 30.0)::INTEGER AS bin FROM events")
def em18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.year_bins(1800 + F.col("event_id") % 221, F.lit(2020)).alias("bin"))


@query("ag13_label_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def ag13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
