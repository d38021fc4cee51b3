"""Queries that prepare a corpus, and those over projections, unions and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import prepare as P
from lectern.plans.catalog import query
from lectern.plans.retrieval import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")



def _meta_keys() -> list:
    return [F.substring("text", 1, 20), F.col("n_chars"), F.size(F.split("text", " "))]


@query("dd01_metadata_dedup", "WITH g AS (SELECT left(text, 20) a, n_chars b, len(string_split(text, ' ')) c, min(doc_id) AS first_id, count(*) AS n_old FROM documents GROUP BY 1, 2, 3) SELECT row_number() OVER (ORDER BY first_id) - 1 AS new_id, first_id, n_old FROM g")
def dd01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dedup(docs(spark, sf_dir), _meta_keys(), "doc_id").select("new_id", "first_id", "n_old")


_DEDUP = "groups AS (SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS n_old FROM documents WHERE text <> '' GROUP BY 1), books AS (SELECT *, row_number() OVER (ORDER BY first_id) - 1 AS new_id FROM groups)"


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dedup(docs(spark, sf_dir).where("text <> ''"), [F.col("text")], "doc_id")


@query("dd02_content_dedup", f"WITH {_DEDUP} SELECT new_id, first_id, n_old, digest FROM books")
def dd02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books(spark, sf_dir)


_SPLIT = "ranked AS (SELECT *, row_number() OVER (ORDER BY md5(new_id::VARCHAR), new_id) - 1 AS r, count(*) OVER () AS n FROM books), split_ AS (SELECT *, CASE WHEN r < floor(n * 0.2) THEN 'test' WHEN r < floor(n * 0.2) + floor(n * 0.1) THEN 'validation' ELSE 'train' END AS split, r - floor(n * 0.2) - floor(n * 0.1) AS p FROM ranked)"


def split_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_assigned(books(spark, sf_dir), "new_id")


@query("dd03_04_split_and_examples", f"WITH {_DEDUP}, {_SPLIT} SELECT new_id, split, p = 0 AS example, p BETWEEN 0 AND 2 AS examples FROM split_")
def dd03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_books(spark, sf_dir).select("new_id", "split", "example", "examples")


@query("dd05_old_id_splits", f"WITH {_DEDUP}, {_SPLIT} SELECT doc_id AS old_id, s.split FROM documents d JOIN split_ s ON sha256(d.text) = s.digest")
def dd05(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = P.old_to_new(docs(spark, sf_dir), [F.col("text")], "doc_id", books(spark, sf_dir))
    return old.join(split_books(spark, sf_dir).select("new_id", "split"), "new_id").select("old_id", "split")


@query("dd06_annotate_default_train", f"WITH {_DEDUP}, {_SPLIT} SELECT d.doc_id, d.source, coalesce(s.split, 'train') AS split FROM documents d LEFT JOIN split_ s ON s.first_id = d.doc_id")
def dd06(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split_books(spark, sf_dir).select(F.col("first_id").alias("doc_id"), "split")
    return docs(spark, sf_dir).select("doc_id", "source").join(s, "doc_id", "left").withColumn("split", F.coalesce("split", F.lit("train")))


@query("dd07_filter_by_right", "SELECT doc_id, source FROM documents WHERE source = 'src0'")
def dd07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "source").where("source = 'src0'")


@query("dd08_option_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS first_value, 1::INTEGER AS n_values FROM events")
def dd08(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.map_values(F.from_json("props", "map<string,bigint>"))
    return table(spark, sf_dir, "events").select("event_id", F.get(values, F.lit(0)).alias("first_value"), F.size(values).alias("n_values"))


@query("dd09_questions_by_book", f"WITH {_DEDUP} SELECT b.new_id, 'Q' || d.doc_id AS question_id FROM documents d JOIN books b ON sha256(d.text) = b.digest JOIN labels l ON l.doc_id = d.doc_id")
def dd09(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = P.old_to_new(docs(spark, sf_dir), [F.col("text")], "doc_id", books(spark, sf_dir))
    asked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("old_id"))
    return old.join(asked, "old_id").select("new_id", F.concat(F.lit("Q"), F.col("old_id").cast("string")).alias("question_id"))


@query("dd10_sequential_question_ids", "SELECT conv_id, turn, printf('Q%04d', row_number() OVER (ORDER BY conv_id, turn) - 1) AS question_id FROM conversations WHERE role = 'user'")
def dd10(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    return P.numbered(q, "conv_id", "turn", name="n").select("conv_id", "turn", F.format_string("Q%04d", "n").alias("question_id"))


@query("dd11_corpus_stats", f"WITH {_DEDUP}, {_SPLIT}, b AS (SELECT s.*, d.n_chars FROM split_ s JOIN documents d ON d.doc_id = s.first_id) SELECT count(*) AS docs_count, (SELECT count(*) FROM labels) AS tasks_count, (sum(n_chars) // count(*))::BIGINT AS avg_token_len, count_if(split = 'train')::BIGINT AS n_train, count_if(split = 'validation')::BIGINT AS n_validation, count_if(split = 'test')::BIGINT AS n_test FROM b")
def dd11(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = split_books(spark, sf_dir).join(docs(spark, sf_dir).select(F.col("doc_id").alias("first_id"), "n_chars"), "first_id")
    return P.corpus_stats(b, "n_chars", table(spark, sf_dir, "labels"))


@query("dd12_split_from_path", r"WITH p AS (SELECT doc_id, 'Books/' || lang || '/' || source || CASE WHEN doc_id % 2 = 0 THEN '.cleaned.txt' ELSE '.tagmap.json' END AS path FROM documents) SELECT doc_id, regexp_extract(path, '^[^/]+/([^/]+)/', 1) AS split, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '(\.cleaned|\.tagmap)?\.[a-z]+$', '') AS stem FROM p")
def dd12(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("doc_id") % 2 == 0, ".cleaned.txt").otherwise(".tagmap.json")
    path = F.concat(F.lit("Books/"), "lang", F.lit("/"), "source", end)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(\.cleaned|\.tagmap)?\.[a-z]+$", "")
    return docs(spark, sf_dir).select("doc_id", F.regexp_extract(path, r"^[^/]+/([^/]+)/", 1).alias("split"), stem.alias("stem"))


@query("dd13_example_tasks", f"WITH {_DEDUP}, {_SPLIT} SELECT d.doc_id, d.lang FROM documents d WHERE d.doc_id IN (SELECT first_id FROM split_ WHERE p BETWEEN 0 AND 2)")
def dd13(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = split_books(spark, sf_dir).where("examples").select(F.col("first_id").alias("doc_id"))
    return docs(spark, sf_dir).select("doc_id", "lang").join(few, "doc_id", "left_semi")


_FAKE = "SELECT vec_id AS start_index, label::VARCHAR AS source_file, CASE label % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'validation' END AS split FROM embeddings"


def _fake_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.get(F.array(F.lit("train"), F.lit("test"), F.lit("validation")), F.col("label") % 3)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("start_index"), F.col("label").cast("string").alias("source_file"), split.alias("split"))


@query("dd14_global_chunk_ids", f"SELECT *, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'test' THEN 2 ELSE 3 END, source_file, start_index) - 1 AS chunk_id FROM ({_FAKE})")
def dd14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chunk_ids(_fake_chunks(spark, sf_dir))


_METAROWS = "SELECT event_type AS method, CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'validation' END AS split, sum(value) AS total_time, count(*) AS chunks_num, avg(value) AS avg_token_len FROM events GROUP BY 1, 2"


def _meta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.get(F.array(F.lit("train"), F.lit("test"), F.lit("validation")), (F.col("user_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method"), split.alias("split")).agg(F.sum("value").alias("total_time"), F.count("*").alias("chunks_num"), F.avg("value").alias("avg_token_len"))


@query("dd15_merge_meta", f"SELECT method, round(sum(total_time), 4) AS total_time, sum(chunks_num)::BIGINT AS chunks_num, round(sum(avg_token_len * chunks_num) / sum(chunks_num), 4) AS avg_token_len FROM ({_METAROWS}) GROUP BY 1")
def dd15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merged_meta(_meta_rows(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("total_time", "avg_token_len")})


@query("ag09_weighted_token_len", f"WITH m AS ({_METAROWS}) SELECT method, round(CASE WHEN count(DISTINCT split) = 3 THEN sum(avg_token_len * chunks_num) / sum(chunks_num) END, 4) AS avg_token_len, count(DISTINCT split) AS n_splits FROM m GROUP BY 1")
def ag09(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_three = F.size(F.array_intersect(F.collect_set("split"), F.array(*[F.lit(s) for s in P.SPLITS]))) == 3
    mean = F.sum(F.col("avg_token_len") * F.col("chunks_num")) / F.sum("chunks_num")
    return _meta_rows(spark, sf_dir).groupBy("method").agg(F.round(F.when(all_three, mean), 4).alias("avg_token_len"), F.countDistinct("split").alias("n_splits"))


@query("dd16_stratified_sample", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS k FROM embeddings) WHERE k <= 7")
def dd16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stratified(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 7)


@query("dd17_uniform_cap", "SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 100")
def dd17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.capped(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 100)


# Projections, filters, unions and sets.


@query("p01_03_project_rename_drop", "SELECT doc_id AS m_doc_id, lang AS m_language FROM documents")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).withColumnRenamed("lang", "language")
    d = d.drop(*[c for c in d.columns if c.endswith("_chars") or c in ("text", "source")])
    return d.toDF(*[f"m_{c}" for c in d.columns])


@query("p04_drop_all_null_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("string").alias("empty"))
    counts = d.agg(*[F.count(c).alias(c) for c in d.columns]).first().asDict()
    return d.drop(*[c for c, n in counts.items() if n == 0])


@query("p05_fill_missing", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic = 1, false) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic")).fillna(0, ["quality"]).fillna(False, ["toxic"])


@query("p06_p16_filters", "SELECT doc_id FROM documents WHERE lang IN ('fr', 'de') OR (lang = 'en' AND source = 'src1')")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.col("lang").isin("fr", "de") | ((F.col("lang") == "en") & (F.col("source") == "src1"))).select("doc_id")


_HOLED = "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS a, CASE WHEN doc_id % 4 > 0 THEN lang END AS b FROM documents"


@query("p07_null_safe_filter", f"SELECT doc_id FROM ({_HOLED}) WHERE NOT (a IS NULL AND b IS NULL) AND a IS DISTINCT FROM 'src1'")
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("a"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("b"))
    return d.where(~(F.col("a").isNull() & F.col("b").isNull()) & ~F.col("a").eqNullSafe("src1")).select("doc_id")


@query("p08_10_key_predicates", f"SELECT doc_id, b FROM ({_HOLED}) WHERE coalesce(contains(a, 'src1'), false) AND NOT coalesce(contains(b, 'e'), false)")
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("a"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("b"))
    has = lambda c, s: F.coalesce(F.contains(c, F.lit(s)), F.lit(False))
    return d.where(has(F.col("a"), "src1") & ~has(F.col("b"), "e")).select("doc_id", "b")


@query("p09_level_slice", "SELECT doc_id, source FROM documents WHERE lang = 'es'")
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where("lang = 'es'").drop("lang", "text", "n_chars")


@query("p12_available_only", "SELECT DISTINCT d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("source").distinct()


@query("p13_14_constant_and_missing_columns", "SELECT vec_id, 'global' AS scope, CAST(NULL AS VARCHAR) AS yearpub FROM embeddings")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit("global").alias("scope"), F.lit(None).cast("string").alias("yearpub"))


@query("p15_explode_positive", "WITH t AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS n FROM documents) SELECT doc_id, count(*) AS lines, sum(n)::BIGINT AS chars FROM t WHERE n > 0 GROUP BY 1")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = docs(spark, sf_dir).select("doc_id", F.explode(F.transform(F.split("text", "\n"), F.length)).alias("n")).where("n > 0")
    return n.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("n").alias("chars"))


@query("so01_union_by_name", "SELECT doc_id AS id, lang, NULL::VARCHAR AS role FROM documents UNION ALL BY NAME SELECT conv_id AS id, role, NULL::VARCHAR AS lang FROM conversations")
def so01(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang"), table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "role")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


@query("so02_distinct", "SELECT DISTINCT lang, source FROM documents")
def so02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("lang", "source").dropDuplicates()


@query("so03_keep_first", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def so03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("so04_intersection", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def so04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where("lang = 'en'").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("so05_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def so05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id").distinct())


@query("so06_all_splits_present", "SELECT source, list_sort(list(DISTINCT lang)) = ['de', 'en', 'es', 'fr'] AS complete FROM documents GROUP BY 1")
def so06(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    return docs(spark, sf_dir).groupBy("source").agg((F.array_sort(F.collect_set("lang")) == full).alias("complete"))
