"""Queries over joins, roll-ups and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import models as M
from lectern.functions import text as T
from lectern.operators import reports as R
from lectern.operators import retrieval as Q
from lectern.plans.catalog import query
from lectern.plans.retrieval import table
from lectern.plans.texts import VERDICT_SQL, verdicts

LANGS = ["de", "en", "es", "fr"]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


def _r(df: DataFrame, *names: str, places: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query("ag07_verdict_ratio", f"WITH {VERDICT_SQL} SELECT toxic, round(100.0 * count_if(verdict = 'correct') / count(verdict), 4) AS ratio, count(verdict) AS n FROM (SELECT toxic, CASE WHEN doc_id % 7 > 0 THEN verdict END AS verdict FROM verdicts) GROUP BY 1 HAVING count(verdict) > 0")
def ag07(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir).withColumn("verdict", F.when(F.col("doc_id") % 7 > 0, F.col("verdict")))
    return _r(R.verdict_ratio(v, "verdict", "toxic"), "ratio")


@query("ag07b_verdict_ratio_all", f"WITH {VERDICT_SQL} SELECT toxic, round(100.0 * count_if(verdict = 'correct') / count(*), 4) AS ratio, count(*) AS n FROM (SELECT toxic, CASE WHEN doc_id % 7 > 0 THEN verdict END AS verdict FROM verdicts) GROUP BY 1")
def ag07b(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir).withColumn("verdict", F.when(F.col("doc_id") % 7 > 0, F.col("verdict")))
    return _r(R.verdict_ratio(v, "verdict", "toxic", all_questions=True), "ratio")


@query("ag04_group_sizes", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def ag04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("ag10_means", "SELECT lang, source, round(avg(n_chars), 4) AS mean FROM documents GROUP BY 1, 2")
def ag10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("lang", "source").agg(F.round(F.avg("n_chars"), 4).alias("mean"))


@query("ag11_lists_kept_long", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS total, max(n_chars) AS most FROM documents GROUP BY 1")
def ag11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.max("n_chars").alias("most"))


@query("ag12_box_plot", "WITH q AS (SELECT lang, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY 1) SELECT q.lang, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(n_chars) AS whisker_low, max(n_chars) AS whisker_high FROM q JOIN documents d ON d.lang = q.lang AND n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL")
def ag12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(R.box_plot(docs(spark, sf_dir), "n_chars", "lang"), "q1", "median", "q3")


_SCORES = "scores AS (SELECT event_type AS config, round(avg(value), 4) AS mean_value, round(max(value), 4) AS max_value, count(*)::DOUBLE AS n FROM events GROUP BY 1)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("config")).agg(F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.max("value"), 4).alias("max_value"), F.count("*").cast("double").alias("n"))


@query("ag14_min_max_table", f"WITH {_SCORES}, l AS (UNPIVOT scores ON mean_value, max_value, n INTO NAME metric VALUE value) SELECT metric, first(config ORDER BY value DESC, config) AS max_key, max(value) AS max_value, first(config ORDER BY value, config) AS min_key, min(value) AS min_value FROM l GROUP BY 1")
def ag14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extremes(scores(spark, sf_dir), "config", ["mean_value", "max_value", "n"])


@query("ag16_average_row", f"WITH {_SCORES} SELECT config, round(mean_value, 4) AS mean_value, round(n, 4) AS n FROM scores UNION ALL SELECT 'AVG', round(avg(mean_value), 4), round(avg(n), 4) FROM scores")
def ag16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(R.with_average_row(scores(spark, sf_dir), "config", ["mean_value", "n"]), "mean_value", "n")


@query("ag17_distinct_questions", "SELECT source, count(DISTINCT lang) AS n_langs, count(DISTINCT n_chars) AS n_lengths FROM documents GROUP BY 1")
def ag17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").agg(F.countDistinct("lang").alias("n_langs"), F.countDistinct("n_chars").alias("n_lengths"))


@query("ag19_timing_totals", "SELECT event_type, round(sum(value), 4) AS total_time, round(sum(value) / count(*), 6) AS mean_time FROM events GROUP BY 1")
def ag19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total_time"), F.round(F.sum("value") / F.count("*"), 6).alias("mean_time"))


@query("ag20_histogram", "WITH e AS (SELECT min(n_chars) AS a, max(n_chars) AS b FROM documents) SELECT least(floor((n_chars - a) / (b - a)::DOUBLE * 20), 19)::INTEGER AS bin, count(*) AS n FROM documents, e GROUP BY 1")
def ag20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.histogram(docs(spark, sf_dir), "n_chars", 20)


@query("ag21_binarised_at_median", "WITH m AS (SELECT median(n_chars) AS m FROM documents) SELECT lang, count_if(n_chars > m)::BIGINT AS above, count(*) AS n FROM documents, m GROUP BY 1")
def ag21(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = docs(spark, sf_dir).agg(F.median("n_chars").alias("m"))
    return docs(spark, sf_dir).crossJoin(F.broadcast(m)).groupBy("lang").agg(F.count_if(F.col("n_chars") > F.col("m")).alias("above"), F.count("*").alias("n"))


@query("pv01_metric_columns", "SELECT source, round(avg(n_chars) FILTER (WHERE lang = 'en'), 4) AS en_mean, nullif(count(*) FILTER (WHERE lang = 'en'), 0) AS en_n, round(avg(n_chars) FILTER (WHERE lang = 'fr'), 4) AS fr_mean, nullif(count(*) FILTER (WHERE lang = 'fr'), 0) AS fr_n FROM documents GROUP BY 1")
def pv01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").pivot("lang", ["en", "fr"]).agg(F.round(F.avg("n_chars"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("pv02_pivot_mean", "SELECT source, " + ", ".join(f"round(avg(n_chars) FILTER (WHERE lang = '{x}'), 4) AS {x}" for x in LANGS) + " FROM documents GROUP BY 1")
def pv02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pivoted(docs(spark, sf_dir), ["source"], "lang", LANGS, F.round(F.avg("n_chars"), 4))


@query("pv03_pivot_filled", "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (WHERE o_orderpriority = '{x}') AS \"{x}\"" for x in ("1-URGENT", "5-LOW", "none")) + " FROM orders GROUP BY 1")
def pv03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pivoted(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", ["1-URGENT", "5-LOW", "none"], F.count(F.lit(1)), 0)


@query("pv04_row_percentages", "SELECT source, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE lang = '{x}') / count(*), 4) AS {x}" for x in LANGS) + " FROM documents GROUP BY 1")
def pv04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_percent(R.pivoted(docs(spark, sf_dir), ["source"], "lang", LANGS, F.count(F.lit(1)), 0), LANGS)


@query("pv05_explode_parallel", "WITH p AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN [lang, source] END AS a, [n_chars, doc_id] AS b FROM documents) SELECT doc_id, i::INTEGER AS pos, a[i + 1] AS item, CASE WHEN a IS NOT NULL THEN b[i + 1] END AS other FROM (SELECT *, unnest(CASE WHEN a IS NULL THEN [0] ELSE [0, 1] END) AS i FROM p)")
def pv05(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("doc_id") % 4 > 0, F.array("lang", "source"))
    zipped = F.when(a.isNotNull(), F.arrays_zip(a.alias("a"), F.array("n_chars", "doc_id").alias("b")))
    x = docs(spark, sf_dir).select("doc_id", F.posexplode_outer(zipped).alias("pos", "z"))
    return x.select("doc_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.col("z")["a"].alias("item"), F.col("z")["b"].alias("other"))


@query("pv06_list_to_columns", "SELECT conv_id, max(text) FILTER (WHERE turn = 0) IS NOT NULL AS has_0, max(length(text)) FILTER (WHERE turn = 0)::INTEGER AS len_0, max(length(text)) FILTER (WHERE turn = 1)::INTEGER AS len_1 FROM conversations GROUP BY 1")
def pv06(spark: SparkSession, sf_dir: str) -> DataFrame:
    lens = F.map_from_entries(F.collect_list(F.struct("turn", F.length("text").alias("n"))))  # one conversation's turns
    x = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lens.alias("m"))
    return x.select("conv_id", F.map_contains_key("m", F.lit(0).cast("long")).alias("has_0"), F.try_element_at("m", F.lit(0).cast("long")).alias("len_0"), F.try_element_at("m", F.lit(1).cast("long")).alias("len_1"))


@query("pv07_transpose", "WITH c AS (SELECT lang, count(*)::DOUBLE AS n, round(avg(n_chars), 4)::DOUBLE AS mean FROM documents GROUP BY 1), l AS (UNPIVOT c ON n, mean INTO NAME key VALUE value) SELECT key, max(value) FILTER (WHERE lang = 'de') AS de, max(value) FILTER (WHERE lang = 'en') AS en, max(value) FILTER (WHERE lang = 'es') AS es, max(value) FILTER (WHERE lang = 'fr') AS fr FROM l GROUP BY 1")
def pv07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = docs(spark, sf_dir).groupBy("lang").agg(F.count("*").cast("double").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))
    return c.transpose("lang")


# Joins.


@query("j01_metadata_many_to_one", "SELECT d.doc_id, d.source, m.first_id, m.n FROM documents d LEFT JOIN (SELECT source, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY 1) m USING (source)")
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = docs(spark, sf_dir).where("source <> 'src3'").groupBy("source").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return R.many_to_one(docs(spark, sf_dir).select("doc_id", "source"), meta, ["source"])


@query("j05_j06_question_and_chunk_text", "SELECT c.conv_id, c.turn, q.text AS question, length(c.text)::INTEGER AS chunk_len FROM conversations c JOIN conversations q ON q.conv_id = c.conv_id AND q.turn = 0 WHERE c.turn > 0")
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    q = c.where("turn = 0").select("conv_id", F.col("text").alias("question"))
    return c.where("turn > 0").join(q, "conv_id").select("conv_id", "turn", "question", F.length("text").alias("chunk_len"))


@query("j07_first_match", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("j09_13_left_joins", "SELECT d.doc_id, l.quality, b.n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT source, lang, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY 1, 2) b ON d.source = b.source AND d.lang = b.lang")
def j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    b = d.where("n_chars > 500").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left").join(b, ["source", "lang"], "left").select("doc_id", "quality", "n")


@query("j14_outer_metrics", "WITH a AS (SELECT source, count(*) AS n_long FROM documents WHERE n_chars > 5000 GROUP BY 1), b AS (SELECT source, count(*) AS n_es FROM documents WHERE lang = 'es' AND n_chars < 400 GROUP BY 1), c AS (SELECT source, round(avg(n_chars), 4) AS mean FROM documents WHERE source > 'src2' GROUP BY 1) SELECT source, n_long, n_es, mean FROM a FULL JOIN b USING (source) FULL JOIN c USING (source)")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    a = d.where("n_chars > 5000").groupBy("source").agg(F.count("*").alias("n_long"))
    b = d.where("lang = 'es' and n_chars < 400").groupBy("source").agg(F.count("*").alias("n_es"))
    c = d.where("source > 'src2'").groupBy("source").agg(F.round(F.avg("n_chars"), 4).alias("mean"))
    return R.outer_joined([a, b, c], ["source"])


@query("j15_join_with_suffix", "WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY 1) SELECT a.source, a.n, b.n AS n_retrieval FROM a LEFT JOIN b USING (source)")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    b = docs(spark, sf_dir).where("lang = 'de'").groupBy("source").agg(F.count("*").alias("n"))
    both = {c: f"{c}_retrieval" for c in b.columns if c in a.columns and c != "source"}
    return a.join(b.withColumnsRenamed(both), "source", "left")


@query("j16_key_intersection", "SELECT d.doc_id, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "toxic")


@query("j20_config_grid", "SELECT r_name AS dataset, n.n_name AS preset, k FROM region, nation n, (VALUES (5), (10), (20)) t(k)")
def j20(spark: SparkSession, sf_dir: str) -> DataFrame:
    ks = spark.createDataFrame([(5,), (10,), (20,)], "k int")
    return R.grid(table(spark, sf_dir, "region").select(F.col("r_name").alias("dataset")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("preset")), ks)


@query("j22_strict_join", "SELECT l.doc_id, d.lang FROM labels l JOIN documents d USING (doc_id)")
def j22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.strictly_joined(table(spark, sf_dir, "labels").select("doc_id"), docs(spark, sf_dir).select("doc_id", "lang"), ["doc_id"], "lang")


@query("j23_path_join", "SELECT a.url, a.page_id AS old_id, b.page_id AS new_id FROM pages a JOIN pages b ON a.url = b.url")
def j23(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("url", F.col("page_id").alias("old_id")).join(p.select("url", F.col("page_id").alias("new_id")), "url")


# Order, budgets, model loops.

_LEN = "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'))"


def ranked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("rank"), "text", T.token_count(F.col("text")).alias("tokens_len"))


@query("tk05_context_budget", f"WITH r AS (SELECT conv_id AS qid, turn + 1 AS rank, {_LEN} AS n FROM conversations), s AS (SELECT qid, rank, sum(n) OVER (PARTITION BY qid ORDER BY rank)::BIGINT AS running_tokens FROM r) SELECT * FROM s WHERE running_tokens <= 120")
def tk05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.within_budget(ranked_turns(spark, sf_dir), 120).select("qid", "rank", "running_tokens")


@query("tk06_07_custom_order", "SELECT lang, source, n, row_number() OVER (ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, lang, n DESC, source) AS place FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)")
def tk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = docs(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))
    at = F.array_position(F.array(F.lit("fr"), F.lit("en")), F.col("lang"))
    w = Window.orderBy(F.when(at > 0, at).otherwise(3), "lang", F.desc("n"), "source")  # a report of few rows
    return g.withColumn("place", F.row_number().over(w).cast("long"))


@query("tk10_top_classes", "SELECT source, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, source LIMIT 5")
def tk10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("ud01_embed_texts")
def ud01(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm2"))


_OVERLAP = "len(list_intersect(list_distinct(list_filter(string_split_regex(lower(q), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')), list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))))"


@query("ud05_overlap_rerank", f"WITH c AS (SELECT conv_id AS qid, turn, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations), s AS (SELECT qid, turn, round(coalesce({_OVERLAP} / nullif(len(list_distinct(list_filter(string_split_regex(lower(q), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))), 0), 0), 6) AS score FROM c WHERE turn > 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, turn) AS rank FROM s) SELECT qid, turn, score, rank FROM r WHERE rank <= 3")
def ud05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("q", F.first("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("turn > 0")
    found = c.select(F.col("conv_id").alias("qid"), "turn", F.col("turn").alias("rank"), "q", "text")
    return Q.rerank(found, F.round(M.overlap_score(F.col("q"), F.col("text")), 6), 3).select("qid", "turn", "score", "rank")


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack, prompt, generate, extract (UD-7)."""
    within = Q.within_budget(ranked_turns(spark, sf_dir).where("rank > 1"), 200)
    chunks = within.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("chunks"), F.sum("tokens_len").alias("chunk_tokens"))
    asked = ranked_turns(spark, sf_dir).where("rank = 1").select("qid", F.col("text").alias("question"))
    options = F.when(F.col("qid") % 2 == 0, F.array(F.lit("yes"), F.lit("no")))
    p = asked.join(chunks, "qid").withColumn("options", options).withColumn("p", T.generation_prompt(F.col("question"), F.col("options"), F.col("chunks")))
    g = M.generated(p.select("qid", "question", "options", "chunks", "chunk_tokens", "p.*"), "system", "user", M.first_option)
    return g.withColumn("answer", T.map_option(T.extract_answer(F.col("raw")), F.col("options")))


@query("ud07_answer_loop")
def ud07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answered(spark, sf_dir).select("qid", "answer", F.size("chunks").alias("num_chunks"), "chunk_tokens")


@query("ud08_judge_loop")
def ud08(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = answered(spark, sf_dir).withColumn("gold", F.coalesce(F.slice("options", 1, 1), F.array(F.lit("the"))))
    p = a.withColumn("p", T.judge_prompt(F.col("question"), F.col("gold"), F.col("answer"))).select("qid", "p.*")
    return M.generated(p, "system", "user", M.exact_judge).select("qid", T.extract_verdict(F.col("raw")).alias("verdict"))
