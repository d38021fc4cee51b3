"""Resolving not-modified revisits of web captures.

A revisit says that a page was as an earlier capture. It is joined as of its
time to the latest earlier full response of the same canonical URL; its
validators (entity tag, or last-modified time where it sends no tag) must agree
with that response, and the headers that a 304 answer may update are merged
over the response's.

The as-of join deals each URL's records by time slices: within a slice a
window finds the latest response, and what a slice inherits comes from one row
for each slice. So one URL with a third of all records meets in no task, and
bodies are never moved: a resolved record names its source.

Defined results: a revisit without an earlier response is ``unresolved``;
without any validator ``unverified`` (still joined); with one that disagrees
``mismatch`` (not joined). Responses at the revisit's own time don't count;
of several at one time the one with the largest id is the latest. A null URL or
time is ``unresolved``; repeated rows resolve each; an empty table gives an
empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import shuffle_width, stored

#: Headers that a 304 answer may carry to update a stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a closing slash dropped; the host in lower case."""
    rest = F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.regexp_replace(path, r"([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&]*", "$1")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"&&+", "&"), r"\?&+", "?"), r"[?&]+$", "")
    path = F.regexp_replace(path, r"/+(\?|$)", "$1")
    return F.concat(host, path)


def resolved(records: DataFrame) -> DataFrame:
    """One row per revisit with its source.

    records: record_id (long), url, time (long), kind ('response' or
    'revisit'), etag, last_modified and headers (array of name and value
    structs, names in lower case).
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), "time", "kind", "etag", "last_modified", "headers")
    whole = rows.where(F.col("url").isNotNull() & F.col("time").isNotNull())
    # Slices by quantiles of time hold about equal shares of all rows.
    parts = max(2, shuffle_width(records.sparkSession))
    edges = whole.agg(F.percentile_approx("time", [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    edges = sorted(set(edges))
    slot = F.lit(0)
    if edges:
        slot = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("time")))
    whole = whole.withColumn("slot", slot.cast("int"))
    body = F.struct("time", F.col("record_id").alias("source_id"), "etag", "last_modified", "headers")
    answer = F.when(F.col("kind") == "response", body)

    # The last response of each URL and slice, then of all slices before: one row a slice.
    last = stored(whole.where("kind = 'response'").groupBy("url", "slot").agg(F.max(body).alias("last")), "slices")
    asked = whole.where("kind = 'revisit'").select("url", "slot").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    marks = last.unionByName(asked).groupBy("url", "slot").agg(F.first("last", ignorenulls=True).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    carried = stored(marks.select("url", "slot", before.alias("carried")).where("carried is not null"), "carried")

    # Revisits sort before responses of their own time, so that only earlier ones count.
    turn = Window.partitionBy("url", "slot").orderBy("time", F.col("kind").desc(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    within = whole.withColumn("near", F.last(answer, ignorenulls=True).over(turn)).where("kind = 'revisit'")
    found = within.join(carried, ["url", "slot"], "left").withColumn("source", F.coalesce("near", "carried"))
    lost = rows.where((F.col("kind") == "revisit") & (F.col("url").isNull() | F.col("time").isNull()))
    found = found.select("record_id", "url", "time", "etag", "last_modified", "headers", "source")
    found = found.unionByName(lost.withColumn("source", F.lit(None).cast(found.schema["source"].dataType)).select(found.columns))

    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    tags, dates = F.col("etag").isNotNull(), F.col("last_modified").isNotNull()
    agrees = F.when(tags, weak(F.col("etag")).eqNullSafe(weak(F.col("source.etag")))).when(dates, F.col("last_modified").eqNullSafe(F.col("source.last_modified")))
    state = F.when(F.col("source").isNull(), "unresolved").when(~(tags | dates), "unverified").when(agrees, "resolved").otherwise("mismatch")
    found = found.withColumn("state", state).withColumn("source", F.when(F.col("state").isin("resolved", "unverified"), F.col("source")))
    new = F.filter(F.coalesce("headers", F.array().cast(found.schema["headers"].dataType)), lambda h: h["name"].isin(*PERMITTED))
    old = F.filter(F.coalesce("source.headers", F.array().cast(found.schema["headers"].dataType)), lambda h: ~F.coalesce(F.exists(new, lambda x: x["name"] == h["name"]), F.lit(False)))
    merged = F.when(F.col("source").isNotNull(), F.array_sort(F.concat(old, new)))
    return found.select("record_id", "url", "time", "state", F.col("source.source_id").alias("source_id"), F.col("source.time").alias("source_time"), merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Captures made from a table of pages, which has no headers or times: a response of each page and a later revisit of it.

    A page is captured at ten times its id. Its revisit follows after 7 to
    4007 units, in the time of other pages, with the page's tag, a weak tag,
    only a date, no validator or a wrong tag, in turn by id.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    turn = F.col("page_id") % 11
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("time"), F.lit("response").alias("kind"), tag.alias("etag"), day.alias("last_modified"),
        F.array(header("content-type", F.lit("text/html")), header("content-length", F.length("html")), header("date", F.col("page_id") * 10), header("etag", tag), header("server", F.lit("a"))).alias("headers"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + 7 + (F.col("page_id") % 5) * 1000).alias("time"), F.lit("revisit").alias("kind"),
        F.when(turn.isin(7, 8), None).when(turn == 9, None).when(turn == 10, F.lit('"0"')).when(turn % 2 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag).alias("etag"),
        F.when(turn.isin(7, 8), day).alias("last_modified"),
        F.array(header("date", F.col("page_id") * 10 + 7), header("content-length", F.lit(0)), header("cache-control", F.lit("max-age=60")), header("server", F.lit("b"))).alias("headers"),
    )
    return full.unionByName(again)


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, time, state, source_page_id, source_time and the merged headers as text, one row per revisit."""
    out = resolved(records_of_pages(pages))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit("")))), "\n")
    return out.select(F.expr("record_id div 2").alias("page_id"), "url", "time", "state", F.expr("source_id div 2").alias("source_page_id"), "source_time", lines.alias("headers"))


#: The same by DuckDB's as-of join.
REVISITS_SQL = r"""
WITH base AS (
  SELECT page_id, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, 'day ' || CAST(page_id % 365 AS VARCHAR) AS day, length(html) AS n,
    regexp_replace(regexp_replace(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') AS rest
  FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_replace(rest, '^[^/?]*', ''), '([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '\1', 'g') AS path
  FROM base),
urls AS (
  SELECT *, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1', 'g') AS canon
  FROM parts),
full_ AS (SELECT canon, page_id AS source_page_id, page_id * 10 AS source_time, tag, day, n FROM urls),
again AS (
  SELECT page_id, canon, page_id * 10 + 7 + (page_id % 5) * 1000 AS time,
    CASE WHEN page_id % 11 IN (7, 8, 9) THEN NULL WHEN page_id % 11 = 10 THEN '"0"' ELSE tag END AS etag,
    CASE WHEN page_id % 11 IN (7, 8) THEN day END AS last_modified
  FROM urls),
joined AS (SELECT a.*, f.source_page_id, f.source_time, f.tag, f.day, f.n FROM again a ASOF LEFT JOIN full_ f ON a.canon = f.canon AND a.time > f.source_time),
judged AS (
  SELECT *, CASE WHEN source_page_id IS NULL THEN 'unresolved' WHEN etag IS NULL AND last_modified IS NULL THEN 'unverified'
    WHEN (etag IS NOT NULL AND etag = tag) OR (etag IS NULL AND last_modified = day) THEN 'resolved' ELSE 'mismatch' END AS state
  FROM joined)
SELECT page_id, canon AS url, time, state,
  CASE WHEN state IN ('resolved', 'unverified') THEN source_page_id END AS source_page_id,
  CASE WHEN state IN ('resolved', 'unverified') THEN source_time END AS source_time,
  CASE WHEN state IN ('resolved', 'unverified') THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || CAST(n AS VARCHAR) || chr(10) || 'content-type: text/html'
    || chr(10) || 'date: ' || CAST(page_id * 10 + 7 AS VARCHAR) || chr(10) || 'etag: ' || tag || chr(10) || 'server: a' END AS headers
FROM judged
"""
