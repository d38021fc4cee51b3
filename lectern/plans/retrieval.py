"""Queries over vector search, reranking, packing and retrieval metrics.

Embeddings stand for chunks and their label for the book; the questions are
the rows whose id is divisible by 100, searched against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.vector import cosine, dot, doubles, norm, normalised, size_factor
from lectern.operators import retrieval as R
from lectern.plans.catalog import query

K = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("book"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "qid")


def found(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    c = chunks(spark, sf_dir)
    hits = R.knn_global(questions(spark, sf_dir), c, k)
    q = questions(spark, sf_dir).select("qid", "book")
    return hits.join(c.select("chunk_id", F.col("book").alias("chunk_book")), "chunk_id").join(q, "qid").withColumn("is_good", F.col("book") == F.col("chunk_book"))


KNN = f"""
chunks AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, label AS book FROM embeddings),
questions AS (SELECT chunk_id AS qid, v, book FROM chunks WHERE chunk_id % 100 = 0),
pairs AS (SELECT qid, q.book, c.chunk_id, c.book AS chunk_book, round(list_sum(list_transform(list_zip(q.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9) AS distance
  FROM questions q, chunks c WHERE q.qid <> c.chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) AS rank FROM pairs),
found AS (SELECT *, book = chunk_book AS is_good FROM ranked WHERE rank <= {K})"""


@query("j02_knn_global", f"WITH {KNN} SELECT qid, rank, chunk_id, round(distance, 6) AS distance FROM found")
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.knn_global(questions(spark, sf_dir), chunks(spark, sf_dir), K).withColumn("distance", F.round("distance", 6))


@query(
    "j03_knn_local",
    f"WITH {KNN}, local AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) AS r FROM pairs WHERE book = chunk_book) "
    "SELECT qid, r AS rank, chunk_id, round(distance, 6) AS distance FROM local WHERE r <= 10",
)
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.knn_local(questions(spark, sf_dir), chunks(spark, sf_dir), 10).withColumn("distance", F.round("distance", 6))


@query("tk01_rerank_nothing", f"WITH {KNN} SELECT qid, rank, chunk_id, 1.0::DOUBLE AS score FROM found WHERE rank <= 5")
def tk01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reranker("nothing")(found(spark, sf_dir), 5).select("qid", "rank", "chunk_id", "score")


_SCORED = f"""WITH {KNN}, scored AS (SELECT f.qid, f.rank, f.chunk_id, round(list_dot_product(q.v, c.v), 9) AS score FROM found f JOIN questions q USING (qid) JOIN chunks c ON c.chunk_id = f.chunk_id),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS new_rank FROM scored)"""


def _scored(spark: SparkSession, sf_dir: str, keep: bool) -> DataFrame:
    c = chunks(spark, sf_dir)
    rows = found(spark, sf_dir).join(questions(spark, sf_dir).select("qid", F.col("vector").alias("q")), "qid").join(c.select("chunk_id", F.col("vector").alias("x")), "chunk_id")
    return R.rerank(rows, F.round(dot(doubles(F.col("q")), doubles(F.col("x"))), 9), 10, keep).select("qid", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("tk02_rerank_topk", f"{_SCORED} SELECT qid, new_rank AS rank, chunk_id, round(score, 6) AS score FROM best WHERE new_rank <= 10")
def tk02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, False)


@query("tk04_rerank_order_preserve", f"{_SCORED} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS rank, chunk_id, round(score, 6) AS score FROM best WHERE new_rank <= 10")
def tk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True)


_USED = "relevant AS (SELECT chunk_book AS book, count(DISTINCT chunk_id) AS total FROM found GROUP BY 1)"
_CORPUS = "relevant AS (SELECT book, count(*) AS total FROM chunks GROUP BY 1)"
_PER = """per AS (SELECT q.qid, q.book, min(CASE WHEN is_good AND rank <= 10 THEN rank END) AS hit_rank, coalesce(sum(CASE WHEN is_good AND rank <= 10 THEN 1 ELSE 0 END), 0) AS hits,
  coalesce(sum(CASE WHEN is_good AND rank <= 10 THEN 1 / log2(rank + 1.0) ELSE 0 END), 0) AS dcg FROM questions q LEFT JOIN found f USING (qid) GROUP BY q.qid, q.book),
full_ AS (SELECT per.*, coalesce(total, 0) AS total_relevant FROM per LEFT JOIN relevant USING (book)),
metrics AS (SELECT qid, book, hit_rank, hits, total_relevant,
  CASE WHEN hit_rank <= 1 THEN 1.0 ELSE 0.0 END AS accuracy_at_1, CASE WHEN hit_rank <= 2 THEN 1.0 ELSE 0.0 END AS accuracy_at_2, CASE WHEN hit_rank <= 3 THEN 1.0 ELSE 0.0 END AS accuracy_at_3,
  CASE WHEN hit_rank <= 4 THEN 1.0 ELSE 0.0 END AS accuracy_at_4, CASE WHEN hit_rank <= 5 THEN 1.0 ELSE 0.0 END AS accuracy_at_5,
  CASE WHEN total_relevant > 0 THEN hits / total_relevant ELSE 0 END AS recall, coalesce(1.0 / hit_rank, 0) AS mrr,
  CASE WHEN (CASE WHEN total_relevant > 0 THEN least(total_relevant, 10) ELSE hits END) = 0 THEN 0
    ELSE dcg / list_sum(list_transform(range(1, CAST(CASE WHEN total_relevant > 0 THEN least(total_relevant, 10) ELSE hits END AS BIGINT) + 1), lambda i: 1 / log2(i + 1.0))) END AS ndcg
  FROM full_)"""
_MEANS = "SELECT round(avg(accuracy_at_1)::DOUBLE, 4) AS accuracy_at_1, round(avg(accuracy_at_2)::DOUBLE, 4) AS accuracy_at_2, round(avg(accuracy_at_3)::DOUBLE, 4) AS accuracy_at_3, round(avg(accuracy_at_4)::DOUBLE, 4) AS accuracy_at_4, round(avg(accuracy_at_5)::DOUBLE, 4) AS accuracy_at_5, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, count(*) AS n_questions FROM metrics"


def _metrics(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    f, q = found(spark, sf_dir), questions(spark, sf_dir).select("qid", "book")
    used = f.groupBy(F.col("chunk_book").alias("book")).agg(F.countDistinct("chunk_id").alias("total_relevant"))
    relevant = used if scope == "used" else chunks(spark, sf_dir).groupBy("book").agg(F.count("*").alias("total_relevant"))
    return R.ir_metrics(f.select("qid", "rank", "is_good"), q, relevant)


@query("flagship_retrieve_and_score", f"WITH {KNN}, {_USED}, {_PER} {_MEANS}")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mean_metrics(_metrics(spark, sf_dir, "used"))


@query("ir06_metrics_corpus_scope", f"WITH {KNN}, {_CORPUS}, {_PER} {_MEANS}")
def ir06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mean_metrics(_metrics(spark, sf_dir, "corpus"))


@query("ir01_05_metrics_per_question", f"WITH {KNN}, {_USED}, {_PER} SELECT qid, book, hit_rank, hits::BIGINT AS hits, total_relevant, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, accuracy_at_5::DOUBLE AS accuracy_at_5 FROM metrics")
def ir01(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir, "used")
    return m.select("qid", "book", "hit_rank", "hits", "total_relevant", *[F.round(x, 6).alias(x) for x in ("recall", "mrr", "ndcg")], "accuracy_at_5")


@query("ir07_hit_at_5", f"WITH {KNN} SELECT q.qid, coalesce(bool_or(is_good AND rank <= 5), false) AS hit FROM questions q LEFT JOIN found f USING (qid) GROUP BY q.qid")
def ir07(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = found(spark, sf_dir).where("rank <= 5").groupBy("qid").agg(F.bool_or("is_good").alias("hit"))
    return questions(spark, sf_dir).select("qid").join(hits, "qid", "left").select("qid", F.coalesce("hit", F.lit(False)).alias("hit"))


_CONFIGS = f"""WITH {KNN}, configs AS (SELECT * FROM (VALUES ('k1', 1), ('k5', 5), ('k20', 20)) t(config, k)),
hits AS (SELECT q.qid, config, coalesce(bool_or(is_good AND rank <= k), false) AS hit FROM questions q CROSS JOIN configs LEFT JOIN found f USING (qid) GROUP BY 1, 2)"""


def _config_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = spark.createDataFrame([("k1", 1), ("k5", 5), ("k20", 20)], "config string, k int")
    f = found(spark, sf_dir).select("qid", F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.lit(k).alias("k")) for c, k in (("k1", 1), ("k5", 5), ("k20", 20))])).alias("c"), "rank", "is_good")
    hits = f.groupBy("qid", F.col("c.config").alias("config")).agg(F.bool_or(F.col("is_good") & (F.col("rank") <= F.col("c.k"))).alias("hit"))
    grid = questions(spark, sf_dir).select("qid").crossJoin(F.broadcast(configs.select("config")))  # three rows
    return grid.join(hits, ["qid", "config"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


@query("ag03_answerability", f"{_CONFIGS} SELECT qid, CASE WHEN bool_and(hit) THEN 'all_hit' WHEN bool_or(hit) THEN 'partial_hit' ELSE 'no_hit' END AS answerability FROM hits GROUP BY qid")
def ag03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.answerability(_config_hits(spark, sf_dir))


@query("ag05_mean_by_config", f"{_CONFIGS} SELECT config, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS mean_hit, count(*) AS n FROM hits GROUP BY config")
def ag05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _config_hits(spark, sf_dir).groupBy("config").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("mean_hit"), F.count("*").alias("n"))


@query("ag06_answered_by_book", f"{_CONFIGS} SELECT book, config, sum(CASE WHEN hit THEN 1 ELSE 0 END)::BIGINT AS answered, count(*) AS total FROM hits JOIN questions USING (qid) GROUP BY 1, 2")
def ag06(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _config_hits(spark, sf_dir).join(questions(spark, sf_dir).select("qid", "book"), "qid")
    return named.groupBy("book", "config").agg(F.count_if("hit").alias("answered"), F.count("*").alias("total"))


@query("ag01_good_and_bad_counts", f"WITH {KNN} SELECT qid, sum(CASE WHEN is_good THEN 1 ELSE 0 END)::BIGINT AS n_good, sum(CASE WHEN is_good THEN 0 ELSE 1 END)::BIGINT AS n_bad FROM found GROUP BY qid")
def ag01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("qid").agg(F.count_if("is_good").alias("n_good"), F.count_if(~F.col("is_good")).alias("n_bad"))


@query("j08_used_chunks", f"WITH {KNN} SELECT chunk_id, book FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM found)")
def j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", "book").join(found(spark, sf_dir).select("chunk_id").distinct(), "chunk_id", "left_semi")


@query("ag18_used_chunk_ids", f"WITH {KNN} SELECT DISTINCT chunk_id FROM found")
def ag18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("chunk_id").distinct()


@query("wn04_06_running_hits", f"WITH {KNN} SELECT qid, rank, max(CASE WHEN is_good THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS hit_so_far, sum(CASE WHEN is_good THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS hits_so_far FROM found WHERE rank <= 5")
def wn06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    good = F.col("is_good").cast("int")
    return found(spark, sf_dir).where("rank <= 5").select("qid", "rank", F.max(good).over(w).alias("hit_so_far"), F.sum(good).over(w).alias("hits_so_far"))


@query("f_vector_functions", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cos, round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm, 1.0::DOUBLE AS unit_norm, round(CASE WHEN a.label <= 20 THEN 1 / (1 + exp(-a.label)) END, 6) AS factor FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("v"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("cos"), F.round(norm(F.col("v")), 6).alias("norm"), F.round(norm(normalised(F.col("v"))), 6).alias("unit_norm"), F.round(size_factor(F.col("label")), 6).alias("factor"))
