"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import boundary as B
from lectern.functions import text as T
from lectern.plans.catalog import query
from lectern.plans.retrieval import table

_B = r"[\s\p{Z}\x1c-\x1f\x85]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_B}+', ''), '{_B}+$', '')"


@query(
    "f_trim_bounds",
    f"WITH l AS (SELECT conv_id, turn, '  ' || text || chr(10) || ' ' AS s FROM conversations) SELECT conv_id, turn, {_strip('s')} AS text, (10 + length(s) - length(regexp_replace(s, '^{_B}+', '')))::INTEGER AS start_index, "
    f"(10 + length(s) - (length(s) - length(regexp_replace(s, '{_B}+$', ''))) - 1)::INTEGER AS end_index FROM l",
)
def trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("  "), F.col("text"), F.lit("\n "))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("s"))
    return c.select("conv_id", "turn", T.trim_bounds(F.col("s"), F.lit(10), F.lit(10) + F.length("s")).alias("t")).select("conv_id", "turn", "t.*")


@query(
    "f_word_and_token_counts",
    f"SELECT doc_id, CAST(round(1.2 * CASE WHEN length({_strip('text')}) = 0 THEN 0 ELSE len(string_split_regex({_strip('text')}, '{_B}+')) END) AS INTEGER) AS words, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'))::INTEGER AS tokens FROM documents",
)
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.token_count(F.col("text")).alias("tokens"))


_RAW = "CASE turn % 5 WHEN 0 THEN 'Answer: ' || text WHEN 1 THEN '<think>Answer: no</think> answers : ' || text WHEN 2 THEN '<THINK>' || text || '</think>' WHEN 3 THEN 'x Answer: A then Answer: ' || role ELSE text END"
_CLEAN = r"regexp_replace(raw, '(?is)<think>.*?</think>', '', 'g')"
_TAIL = _strip("list_extract(string_split_regex(raw, '(?i)</think>'), -1)")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = F.col("turn") % 5, F.col("text")
    raw = F.when(t == 0, F.concat(F.lit("Answer: "), s)).when(t == 1, F.concat(F.lit("<think>Answer: no</think> answers : "), s)).when(t == 2, F.concat(F.lit("<THINK>"), s, F.lit("</think>")))
    raw = raw.when(t == 3, F.concat(F.lit("x Answer: A then Answer: "), F.col("role"))).otherwise(s)
    return table(spark, sf_dir, "conversations").withColumn("raw", raw)


@query(
    "f_extract_answer",
    f"WITH r AS (SELECT *, {_RAW} AS raw FROM conversations) SELECT conv_id, turn, coalesce(nullif({_strip(f"regexp_extract({_CLEAN}, '(?is)answers?\\s*:\\s*(.*)', 1)")}, ''), nullif({_TAIL}, ''), {_strip('raw')}) AS answer FROM r",
)
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("conv_id", "turn", T.extract_answer(F.col("raw")).alias("answer"))


_SAID = "CASE doc_id % 6 WHEN 0 THEN 'Verdict: Correct' WHEN 1 THEN 'verdict : correct or incorrect' WHEN 2 THEN NULL WHEN 3 THEN '<think>Verdict: incorrect</think> Verdict: correct' WHEN 4 THEN 'it is correct' ELSE 'Verdict: unsure' END"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ["Verdict: Correct", "verdict : correct or incorrect", None, "<think>Verdict: incorrect</think> Verdict: correct", "it is correct", "Verdict: unsure"]
    raw = F.get(F.array(*[F.lit(s) for s in said]), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", T.extract_verdict(raw).alias("verdict"))


_LAST = r"CASE WHEN regexp_matches(clean, '(?i)verdict\s*:') THEN regexp_extract(clean, '(?is)verdict\s*:\s*(.*)', 1) ELSE list_extract(string_split_regex(raw, '(?i)</think>'), -1) END"
VERDICT_SQL = f"""r AS (SELECT *, {_SAID} AS raw FROM labels), c AS (SELECT *, {_CLEAN} AS clean FROM r), s AS (SELECT *, lower({_LAST}) AS said FROM c),
verdicts AS (SELECT doc_id, quality, toxic, CASE WHEN contains(said, 'incorrect') THEN 'incorrect' WHEN contains(said, 'correct') THEN 'correct' ELSE 'incorrect' END AS verdict FROM s)"""


@query("f_extract_verdict", f"WITH {VERDICT_SQL} SELECT doc_id, verdict FROM verdicts")
def f_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).select("doc_id", "verdict")


@query(
    "f_map_option",
    "WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' b ' WHEN 1 THEN 'Z' WHEN 2 THEN 'AB' ELSE 'a' END AS answer, CASE WHEN doc_id % 5 <> 0 THEN [lang, source] END AS options FROM documents) "
    "SELECT doc_id, CASE WHEN options IS NOT NULL AND upper(trim(answer)) = 'A' THEN options[1] WHEN options IS NOT NULL AND upper(trim(answer)) = 'B' THEN options[2] ELSE answer END AS mapped FROM a",
)
def f_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    answer = F.when(k == 0, " b ").when(k == 1, "Z").when(k == 2, "AB").otherwise("a")
    options = F.when(F.col("doc_id") % 5 != 0, F.array("lang", "source"))
    return table(spark, sf_dir, "documents").select("doc_id", T.map_option(answer, options).alias("mapped"))


_PROMPT_SQL = """WITH q AS (SELECT conv_id, min_by(text, turn) AS question, list(text ORDER BY turn) FILTER (WHERE turn > 0) AS chunks, CASE WHEN conv_id % 2 = 0 THEN ['yes', 'no'] END AS options FROM conversations GROUP BY conv_id),
p AS (SELECT *, 'Question:' || chr(10) || question AS ask, chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(list_reduce(list_transform(range(1, len(chunks) + 1), lambda i: '[' || i || '] ' || chunks[i]), lambda a, b: a || chr(10) || b), '') AS context FROM q)
SELECT conv_id, md5(CASE WHEN options IS NULL THEN ask || context || chr(10) || chr(10) || 'Reply only: Answer: <answer>' ELSE ask || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. yes' || chr(10) || 'B. no' || context || chr(10) || chr(10) || 'Reply only: Answer: <letter>' END) AS user_md5,
  CASE WHEN options IS NULL THEN 'open' ELSE 'choice' END AS form FROM p WHERE len(chunks) > 0"""


@query("f_generation_prompt", _PROMPT_SQL)
def f_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    later = F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", "text")))  # one conversation's turns
    q = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.transform(F.array_sort(later), lambda x: x["text"]).alias("chunks")).where(F.size("chunks") > 0)
    q = q.withColumn("options", F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("yes"), F.lit("no"))))
    p = T.generation_prompt(F.col("question"), F.col("options"), F.col("chunks"))
    return q.select("conv_id", F.md5(p["user"]).alias("user_md5"), F.when(p["system"].contains("<letter>"), "choice").otherwise("open").alias("form"))


@query("f_judge_prompt", "SELECT item_id, md5('Question:' || chr(10) || 'q' || item_id || chr(10) || chr(10) || 'Reference answers:' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || chr(10) || 'Candidate answer:' || chr(10) || text) AS user_md5 FROM benchmark")
def f_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.judge_prompt(F.concat(F.lit("q"), F.col("item_id").cast("string")), F.array(F.lit("a"), F.lit("b")), F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(p["user"]).alias("user_md5"))


@query(
    "f_boundary_prompt_and_id",
    "SELECT item_id, md5(chr(10) || 'Document:' || chr(10) || 'ID ' || item_id || ': ' || text || chr(10) || 'ID ' || (item_id + 1) || ': end') AS user_md5, "
    "CASE item_id % 3 WHEN 0 THEN item_id WHEN 1 THEN item_id + 1 END AS boundary FROM benchmark",
)
def f_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    said = F.when(i % 3 == 0, F.concat(F.lit("Answer: ID "), i.cast("string"), F.lit(" not ID 7"))).when(i % 3 == 1, F.concat(F.lit("maybe ID "), (i + 1).cast("string"))).otherwise("nothing")
    p = T.boundary_prompt(F.array("text", F.lit("end")), i)
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(p["user"]).alias("user_md5"), T.boundary_id(said).alias("boundary"))


_YEARS = ["1853-1857", "L.M. Foo 1828", "1900.0", "Unknown", "ann", " 1999 "]


@query(
    "f_year_parse",
    "WITH y AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '1853-1857' WHEN 1 THEN 'L.M. Foo 1828' WHEN 2 THEN '1900.0' WHEN 3 THEN 'Unknown' WHEN 4 THEN 'ann' WHEN 5 THEN ' 1999 ' END AS p FROM events) "
    "SELECT event_id, CASE p WHEN '1853-1857' THEN 1853 WHEN 'L.M. Foo 1828' THEN 1828 WHEN '1900.0' THEN 1900 WHEN ' 1999 ' THEN 1999 WHEN 'Unknown' THEN NULL ELSE event_id % 100 + 1800 END::INTEGER AS year FROM y",
)
def f_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.get(F.array(*[F.lit(y) for y in _YEARS]), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", T.best_year(p, (F.col("event_id") % 100 + 1800).cast("string")).alias("year"))


@query("f_genre_explode", "WITH g AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(source || '; ' || lang || ' ; ;', ';'), lambda x: trim(x)), lambda x: x <> '')) AS genre FROM documents) SELECT genre, count(*) AS n FROM g GROUP BY 1")
def f_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.concat("source", F.lit("; "), "lang", F.lit(" ; ;"))
    return table(spark, sf_dir, "documents").select(F.explode(T.genre_tags(tags)).alias("genre")).groupBy("genre").agg(F.count("*").alias("n"))


@query(
    "f_format_and_labels",
    "SELECT event_id, CASE WHEN x IS NULL THEN '' WHEN x < 60 THEN printf('%.2f s', x) WHEN x < 3600 THEN printf('%.2f min', x / 60) ELSE printf('%.2f h', x / 3600) END AS t, "
    "event_type || ' | ' || user_id AS label, CASE WHEN user_id % 2 = 0 THEN event_type ELSE event_type || ' (' || user_id || ')' END AS label_with, printf('%.1f%%', 100.0 * (event_id % 8) / 8) AS pct FROM (SELECT *, CASE WHEN event_id % 9 > 0 THEN event_id::DOUBLE * 0.7137::DOUBLE END AS x FROM events)",
)
def f_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", T.format_seconds(F.when(F.col("event_id") % 9 > 0, F.col("event_id").cast("double") * F.lit(0.7137))).alias("t"), T.label(F.col("event_type"), u).alias("label"), T.label_with(F.col("event_type"), F.when(F.col("user_id") % 2 == 1, u)).alias("label_with"), T.percent(F.col("event_id") % 8, F.lit(8)).alias("pct"))


@query(
    "f_first_different_line",
    "WITH p AS (SELECT a.doc_id, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), "
    "d AS (SELECT doc_id, list_position(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: x[i] IS DISTINCT FROM y[i]), true) AS pos FROM p) SELECT doc_id, CASE WHEN pos > 0 THEN pos END::BIGINT AS line FROM d",
)
def f_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    return d.join(after, "doc_id").select("doc_id", T.first_different_line(F.col("text"), F.col("other")).cast("long").alias("line"))


@query("f_substring_search", "SELECT item_id, count(*) AS n FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def f_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage in every document: one automaton of all passages, one pass over the texts."""
    from collections.abc import Iterator

    import pyarrow as pa

    items = table(spark, sf_dir, "benchmark").select("item_id", "text").toArrow()  # the query set, a fixed list of passages
    if items.nbytes > 64 << 20:
        raise ValueError("the passages do not fit in a task; search them in parts")
    passages = list(zip(items["item_id"].to_pylist(), items["text"].to_pylist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for i, t in passages:
            by_text.setdefault(t, []).append(i)
        a = ahocorasick.Automaton()
        for t in by_text:
            a.add_word(t, t)
        a.make_automaton()
        for b in batches:
            hits = [i for t in b.column(0) if t.is_valid for p in {p for _, p in a.iter(t.as_py())} for i in by_text[p]]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64())], ["item_id"])

    return table(spark, sf_dir, "documents").select("text").mapInArrow(run, "item_id long").groupBy("item_id").agg(F.count("*").alias("n"))


@query(
    "f_lists_and_keys",
    "SELECT doc_id, len(list_slice(string_split(text, ' '), 1, 10))::INTEGER AS first_n, least(len(string_split(text, ' ')), 3)::INTEGER AS last_rank, 'a' || doc_id AS chunking, 'p' AS preset, lang AS embed, 'q' AS embed_preset FROM documents",
)
def f_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("text", " ")
    key = F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit("-p-"), F.col("lang"), F.lit("-q"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.first_items(w)).alias("first_n"), F.element_at(T.ranks(T.first_items(w, 3)), -1).alias("last_rank"), T.key_parts(key).alias("k")).select("doc_id", "first_n", "last_rank", "k.*")


_N = r"""[\s\p{Z}\x1c-\x1f\x85"''„”«»()\[\]{}-—]+"""
_C = r"""["''»”’)\]}]*"""
GOOD_SQL = rf"""(length(coalesce(prev, '')) > 0 AND length(coalesce(next, '')) > 0 AND regexp_replace(coalesce(between_, ''), '{_N}', '', 'g') = '' AND (
  ((regexp_matches(prev, '[.!?…]{_C}{_B}*$') OR regexp_matches(prev, '[:;,.?!]{_B}*[-—]{_C}{_B}*$')) AND regexp_matches(next, '^[\s\p{{Z}}\x1c-\x1f\x85"''„”«»(\[]*[A-ZĄĆĘŁŃÓŚŹŻ]'))
  OR contains(coalesce(between_, ''), chr(10) || chr(10)) OR (suffix(prev, '!') AND between_ = ' ' AND regexp_matches(next, '^\p{{Ll}}'))
  OR (regexp_matches(prev, '\n[IVXLCDM]+$') AND between_ = chr(10)) OR suffix(prev, '—"') OR (suffix(prev, ';') AND between_ = ' ' AND left(next, 1) IN ('''', '"'))
  OR prefix(next, '—') OR (suffix(prev, ':') AND between_ IN (' ', chr(10)) AND regexp_matches(next, '^\p{{Lu}}'))))"""


@query(
    "f_good_boundary",
    f"WITH t AS (SELECT conv_id, turn, text AS prev, CASE turn % 4 WHEN 0 THEN ' ' WHEN 1 THEN chr(10) || chr(10) WHEN 2 THEN 'x' ELSE chr(10) END AS between_, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) SELECT conv_id, turn, coalesce({GOOD_SQL}, false) AS good FROM t",
)
def f_bnd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    gap = F.get(F.array(F.lit(" "), F.lit("\n\n"), F.lit("x"), F.lit("\n")), (F.col("turn") % 4).cast("int"))
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("after", after).select("conv_id", "turn", B.good_boundary(F.col("text"), gap, F.col("after")).alias("good"))
