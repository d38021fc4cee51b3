"""Queries over chunkers and split-point analysis.

Pages give markup: a tag's span runs from its opening to its closing mark in
the html, by the expression's own match of the innermost pair, at the place of
that match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import chunkers as C
from lectern.operators import splits as S
from lectern.plans.catalog import query
from lectern.plans.retrieval import table

SIZE, OVERLAP = 500, 50
_STRIDES = f"strides AS (SELECT doc_id, s AS start_index, least(s + {SIZE}, length(text)) - 1 AS end_index, substr(text, s + 1, {SIZE}) AS text FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), {SIZE - OVERLAP})) AS s FROM documents))"


@query("ch_stride_char_chunks", f"WITH {_STRIDES} SELECT doc_id, start_index::INTEGER AS start_index, end_index::INTEGER AS end_index, md5(text) AS text_md5 FROM strides")
def strides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.strides(table(spark, sf_dir, "documents"), SIZE, OVERLAP, "doc_id").select("doc_id", "start_index", "end_index", F.md5("text").alias("text_md5"))


@query(
    "ch02_token_windows",
    "WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n\\t]+'), lambda x: x <> '') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 128) / 112.0)::BIGINT, 0) + 1)) AS i FROM w WHERE len(w) > 0) "
    "SELECT doc_id, (i * 112)::INTEGER AS first_token, len(list_slice(w, i * 112 + 1, i * 112 + 128))::INTEGER AS tokens_len, md5(array_to_string(list_slice(w, i * 112 + 1, i * 112 + 128), ' ')) AS text_md5 FROM i",
)
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.token_windows(table(spark, sf_dir, "documents"), 128, 16, "doc_id").select("doc_id", "first_token", "tokens_len", F.md5("text").alias("text_md5"))


@query("ch11_sentence_split", "SELECT doc_id, len(s)::INTEGER AS n, md5(array_to_string(s, '')) AS joined_md5 FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*\\s*') AS s FROM documents)")
def sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*\s*"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "")).alias("joined_md5"))


@query("ag15_chunk_stats", f"WITH {_STRIDES} SELECT doc_id % 10 AS split, count(*) AS chunks_num, (sum(length(text)) // count(*))::BIGINT AS avg_len FROM strides GROUP BY 1")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.strides(table(spark, sf_dir, "documents"), SIZE, OVERLAP, "doc_id")
    return c.groupBy((F.col("doc_id") % 10).alias("split")).agg(F.count("*").alias("chunks_num"), F.floor(F.try_divide(F.sum(F.length("text")), F.count("*"))).alias("avg_len"))


@query(
    "ch08_hac_single_linkage",
    "WITH g AS (SELECT label, vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER w), 9) AS gap FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)), "
    "r AS (SELECT *, sum(CASE WHEN gap >= 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS group_no FROM g) SELECT label, group_no::BIGINT AS group_no, min(vec_id) AS first_pos, max(vec_id) AS last_pos, count(*) AS n FROM r GROUP BY 1, 2",
)
def hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.hac_runs(table(spark, sf_dir, "embeddings"), 1.0, "label", "vec_id", "embedding")


def _chunker(name: str, method: str, **params: object) -> None:
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), "text")
        return C.chunked(books, method, params)


_chunker("ch01_fixed_size_sentences", "fixed_size", chunk_size=800, overlap=100)
_chunker("ch02_fixed_size_tokens", "fixed_size", chunk_size=128, overlap=16, mode="token")
_chunker("ch03_recursive", "recursive", chunk_size=800, min_characters_per_chunk=50)
_chunker("ch04_semantic", "semantic", threshold=0.3, chunk_size=256)
_chunker("ch05_neural_fallback", "neural")
_chunker("ch06_recursive_semantic", "recursive_semantic")
_chunker("ch07_max_min", "max_min", hard_threshold=0.2, c_param=0.9, init_const=1.5)
_chunker("ch08_sequential_hac", "sequential_hac", distance_threshold=0.9)
_chunker("ch09_lumber", "lumber", group_size_threshold=200)


@query("ch13_segment_file")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_file"), "text")
    return C.chunked(books, "packed_sentences", {"most": 2000})


# Split points. Strides without overlap over documents; tags over pages.

_CHUNKS = "chunks AS (SELECT doc_id AS book, i AS chunk_id, i * 700 AS start_index, least(i * 700 + 690, length(text)) - 1 AS end_index FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 700.0)::BIGINT)) AS i FROM documents))"


def chunks(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    n = F.ceil(F.length(text) / 700).cast("int")
    rows = table(spark, sf_dir, name).where(F.length(text) > 0).select(F.col(key).alias("book"), F.length(text).alias("len"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_id"))
    return rows.select("book", "chunk_id", (F.col("chunk_id") * 700).alias("start_index"), (F.least(F.col("chunk_id") * 700 + 690, F.col("len")) - 1).alias("end_index"))


from lectern.plans.texts import GOOD_SQL  # noqa: E402

_BOUNDS = f"""{_CHUNKS}, n AS (SELECT *, lead(start_index) OVER w AS s2, lead(end_index) OVER w AS e2 FROM chunks WINDOW w AS (PARTITION BY book ORDER BY chunk_id)),
p AS (SELECT book, chunk_id, substr(text, start_index + 1, end_index + 1 - start_index) AS prev, substr(text, end_index + 2, s2 - end_index - 1) AS between_, substr(text, s2 + 1, e2 + 1 - s2) AS next FROM n JOIN documents ON doc_id = book WHERE s2 IS NOT NULL),
bounds AS (SELECT book, chunk_id, coalesce({GOOD_SQL}, false) AS good FROM p)"""


@query("sp01_sentence_boundaries", f"WITH {_BOUNDS} SELECT book, count_if(good)::BIGINT AS correct, count_if(NOT good)::BIGINT AS incorrect, count(*) AS total FROM bounds GROUP BY 1")
def sp01(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), "text")
    return S.sentence_report(S.sentence_boundaries(chunks(spark, sf_dir), books))


_PAGES = _CHUNKS.replace("doc_id AS book", "page_id AS book").replace("doc_id, text", "page_id, html AS text").replace("least(i * 700 + 690, length(text))", "least(i * 700 + 690, length(text))").replace("length(text) / 700.0", "length(html) / 700.0").replace("FROM documents", "FROM pages")
_ELEMENT = "<(h[1-6]|p|pre)>[^<]*</(h[1-6]|p|pre)>"
_TAGS = rf"""parts AS (SELECT page_id AS book, regexp_extract_all(html, '{_ELEMENT}') AS m, list_transform(string_split_regex(html, '{_ELEMENT}'), lambda x: length(x)) AS between FROM pages),
one AS (SELECT book, unnest(m) AS t, generate_subscripts(m, 1) AS i, list_transform(m, lambda x: length(x)) AS own, between FROM parts),
tags AS (SELECT book, i - 1 AS tag_id, regexp_extract(t, '^<([a-z0-9]+)>', 1) AS tag_name, list_sum(between[1:i]) + coalesce(list_sum(own[1:i - 1]), 0) AS tag_start, list_sum(between[1:i]) + list_sum(own[1:i]) - 1 AS tag_end FROM one)"""


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, "pages", "page_id", "html")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements without inner markup, each at its own place: the lengths of all that comes before it, added up."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    m, between = F.regexp_extract_all("html", F.lit(_ELEMENT), F.lit(0)), F.split("html", _ELEMENT)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("book"), F.arrays_zip(m.alias("t"), between.alias("before")).alias("e"))
    one = pages.select("book", F.posexplode("e").alias("tag_id", "e"), "e").toDF("book", "tag_id", "one", "all").where("one.t is not null")
    start = total(F.slice("all.before", F.lit(1), F.col("tag_id") + 1)) + total(F.slice("all.t", F.lit(1), F.col("tag_id")))
    return one.select("book", "tag_id", F.regexp_extract("one.t", "^<([a-z0-9]+)>", 1).alias("tag_name"), start.alias("tag_start"), (start + F.length("one.t") - 1).alias("tag_end"))


_SPANS = f"{_PAGES}, {_TAGS}, o AS (SELECT t.*, c.chunk_id, c.start_index, c.end_index FROM tags t JOIN chunks c ON t.book = c.book AND NOT (tag_start > end_index OR tag_end < start_index)), spans AS (SELECT book, tag_id, tag_name, count(*) AS n_chunks, count(*) = 1 AND bool_and(tag_start >= start_index AND tag_end <= end_index) AS inside FROM o GROUP BY 1, 2, 3)"


@query("j17_tag_overlap", f"WITH {_SPANS} SELECT book, tag_id::INTEGER AS tag_id, chunk_id::INTEGER AS chunk_id FROM o")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overlaps(page_chunks(spark, sf_dir), tags(spark, sf_dir)).select("book", "tag_id", "chunk_id")


@query("sp02_tag_classes", f"WITH {_SPANS} SELECT book, tag_id::INTEGER AS tag_id, tag_name, n_chunks, inside FROM spans")
def sp02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tag_spans(page_chunks(spark, sf_dir), tags(spark, sf_dir))


_REPORT = "count_if(inside)::BIGINT AS inside, count_if(NOT inside)::BIGINT AS splited, count(*) AS total, round(avg(CASE WHEN NOT inside THEN n_chunks END), 6) AS avg_split_span, max(CASE WHEN NOT inside THEN n_chunks END) AS max_split_span, round(count_if(inside) / count(*), 6) AS block_integrity_rate FROM spans"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("sp03_block_integrity", f"WITH {_SPANS} SELECT book, tag_name, {_REPORT} GROUP BY 1, 2")
def sp03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.tag_report(sp02(spark, sf_dir), "book", "tag_name"), "avg_split_span", "block_integrity_rate")


@query("ag08_split_rollup", f"WITH {_SPANS} SELECT tag_name, {_REPORT} GROUP BY 1")
def ag08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.tag_report(sp02(spark, sf_dir), "tag_name"), "avg_split_span", "block_integrity_rate")


@query("sp07_percent_rollup", f"WITH {_SPANS} SELECT tag_name, round(100.0 * count_if(inside) / count(*), 4) AS inside_percent, round(100.0 * count_if(NOT inside) / count(*), 4) AS splited_percent FROM spans GROUP BY 1")
def sp07(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.tag_report(sp02(spark, sf_dir), "tag_name")
    return r.select("tag_name", F.round(100 * F.col("inside") / F.col("total"), 4).alias("inside_percent"), F.round(100 * F.col("splited") / F.col("total"), 4).alias("splited_percent"))


_EDGES = f"""{_PAGES}, {_TAGS}, n AS (SELECT *, lag(end_index) OVER w AS e0, lead(start_index) OVER w AS s2 FROM chunks WINDOW w AS (PARTITION BY book ORDER BY chunk_id)),
z AS (SELECT *, CASE WHEN e0 + 1 <= start_index - 1 THEN e0 + 1 ELSE start_index END AS lo, CASE WHEN end_index + 1 <= s2 - 1 THEN s2 - 1 ELSE end_index END AS hi FROM n),
edges AS (SELECT z.book, chunk_id, e0 IS NOT NULL AND coalesce(bool_or(tag_start BETWEEN lo AND start_index), false) AS good_start, s2 IS NOT NULL AND coalesce(bool_or(tag_end BETWEEN end_index AND hi), false) AS good_end, s2 IS NULL AS is_last FROM z LEFT JOIN tags t ON t.book = z.book GROUP BY z.book, chunk_id, e0, s2, lo, hi, start_index, end_index)"""


@query("sp04_good_edges", f"WITH {_EDGES} SELECT book, chunk_id::INTEGER AS chunk_id, good_start, good_end FROM edges")
def sp04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.edges(page_chunks(spark, sf_dir), tags(spark, sf_dir)).select("book", "chunk_id", "good_start", "good_end")


@query(
    "sp05_boundary_violations",
    f"WITH {_EDGES}, v AS (SELECT *, NOT is_last AND NOT good_end AND NOT lead(good_start) OVER (PARTITION BY book ORDER BY chunk_id) AS broken FROM edges) "
    "SELECT book, count(*) - 1 AS total_boundaries, count_if(good_start)::BIGINT AS good_start, count_if(good_end)::BIGINT AS good_end, round(CASE WHEN count(*) > 1 THEN count_if(good_start) / (count(*) - 1) END, 6) AS bpr_start, "
    "round(CASE WHEN count(*) > 1 THEN count_if(good_end) / (count(*) - 1) END, 6) AS bpr_end, count_if(broken)::BIGINT AS violations, round(CASE WHEN count(*) > 1 THEN count_if(broken) / (count(*) - 1) END, 6) AS violation_rate FROM v GROUP BY 1",
)
def sp05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.edge_report(S.edges(page_chunks(spark, sf_dir), tags(spark, sf_dir))), "bpr_start", "bpr_end", "violation_rate")


@query("sp06_orphans", f"WITH {_SPANS} SELECT c.book, count(*) AS orphaned FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.book = c.book AND o.chunk_id = c.chunk_id) GROUP BY 1")
def sp06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.orphans(page_chunks(spark, sf_dir), tags(spark, sf_dir)).groupBy("book").agg(F.count("*").alias("orphaned"))


@query("wn01_02_neighbours_and_gaps", f"WITH {_CHUNKS} SELECT book, chunk_id::INTEGER AS chunk_id, (lag(end_index) OVER w + 1)::INTEGER AS gap_first, (lead(start_index) OVER w - 1)::INTEGER AS gap_last FROM chunks WINDOW w AS (PARTITION BY book ORDER BY chunk_id)")
def wn01(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("book").orderBy("chunk_id")
    return chunks(spark, sf_dir).select("book", "chunk_id", (F.lag("end_index").over(w) + 1).alias("gap_first"), (F.lead("start_index").over(w) - 1).alias("gap_last"))
