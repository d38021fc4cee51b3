"""Split-point analysis: how chunk boundaries fall on sentences and on markup.

chunks: book, chunk_id, start_index, end_index (inclusive); tags: book,
tag_id, tag_name, tag_start, tag_end (closed). Interval joins run over buckets
of positions, so that a long book is many keys and not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from lectern.functions.boundary import good_boundary

#: Fixed value: the tags that count.
TRACKED = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "pre")
#: Characters of a position bucket.
BUCKET = 4096
def _book() -> WindowSpec:
    return Window.partitionBy("book").orderBy("chunk_id")



def _buckets(first: str, last: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(first) / BUCKET), F.floor(F.col(last) / BUCKET)))


def overlaps(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag and chunk pairs that share a position (J-17): equal book and bucket, each pair once, in its first common bucket."""
    t = tags.where(F.col("tag_name").isin(*TRACKED) & (F.col("tag_start") <= F.col("tag_end"))).withColumn("_b", _buckets("tag_start", "tag_end"))
    c = chunks.where(F.col("start_index") <= F.col("end_index")).withColumn("_b", _buckets("start_index", "end_index"))
    meet = (F.col("tag_start") <= F.col("end_index")) & (F.col("tag_end") >= F.col("start_index"))
    once = F.col("_b") == F.floor(F.greatest("tag_start", "start_index") / BUCKET)
    return t.join(c, ["book", "_b"]).where(meet & once).drop("_b")


def sentence_boundaries(chunks: DataFrame, books: DataFrame) -> DataFrame:
    """book, chunk_id and good of every boundary between neighbours (SP-1, WN-1). books: book, text."""
    nxt = lambda c: F.lead(c).over(_book())
    pairs = chunks.select("book", "chunk_id", "start_index", "end_index", nxt("start_index").alias("s2"), nxt("end_index").alias("e2")).where("s2 is not null")
    t = F.col("text")
    cut = lambda a, b: F.substring(t, a + 1, F.greatest(b - a, F.lit(0)))
    rows = pairs.join(books.select("book", "text"), "book")
    good = good_boundary(cut(F.col("start_index"), F.col("end_index") + 1), cut(F.col("end_index") + 1, F.col("s2")), cut(F.col("s2"), F.col("e2") + 1))
    return rows.select("book", "chunk_id", good.alias("good"))


def sentence_report(boundaries: DataFrame) -> DataFrame:
    return boundaries.groupBy("book").agg(F.count_if("good").alias("correct"), F.count_if(~F.col("good")).alias("incorrect"), F.count("*").alias("total"))


def tag_spans(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """book, tag_id, tag_name, n_chunks and inside of every tag that meets a chunk (SP-2)."""
    o = overlaps(chunks, tags).groupBy("book", "tag_id", "tag_name").agg(
        F.count("*").alias("n_chunks"), F.bool_and((F.col("tag_start") >= F.col("start_index")) & (F.col("tag_end") <= F.col("end_index"))).alias("_in")
    )
    return o.select("book", "tag_id", "tag_name", "n_chunks", ((F.col("n_chunks") == 1) & F.col("_in")).alias("inside"))


def tag_report(spans: DataFrame, *keys: str) -> DataFrame:
    """inside, splited and total with mean and largest span of split tags, and the block integrity rate (SP-3, AG-8), from sums."""
    split = ~F.col("inside")
    return spans.groupBy(*keys).agg(
        F.count_if("inside").alias("inside"), F.count_if(split).alias("splited"), F.count("*").alias("total"),
        F.avg(F.when(split, F.col("n_chunks"))).alias("avg_split_span"), F.max(F.when(split, F.col("n_chunks"))).alias("max_split_span"),
        F.try_divide(F.count_if("inside"), F.count("*")).alias("block_integrity_rate"),
    )


def gaps(chunks: DataFrame) -> DataFrame:
    """chunks with gap_lo (first position of the gap before, else start), gap_hi (last of the gap after, else end), is_first and is_last (WN-2, WN-9)."""
    lo, hi = F.lag("end_index").over(_book()) + 1, F.lead("start_index").over(_book()) - 1
    return chunks.select(
        "book", "chunk_id", "start_index", "end_index",
        F.when(lo <= F.col("start_index") - 1, lo).otherwise(F.col("start_index")).alias("gap_lo"),
        F.when(F.col("end_index") + 1 <= hi, hi).otherwise(F.col("end_index")).alias("gap_hi"),
        F.lag("chunk_id").over(_book()).isNull().alias("is_first"), F.lead("chunk_id").over(_book()).isNull().alias("is_last"),
    )


def edges(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """book, chunk_id, good_start and good_end: whether a tag opens in the zone at the start, or closes in the one at the end (SP-4, J-18)."""
    g = gaps(chunks)
    t = tags.where(F.col("tag_name").isin(*TRACKED))

    def zone(lo: str, hi: str, at: str, name: str) -> DataFrame:
        z = g.select("book", "chunk_id", F.col(lo).alias("lo"), F.col(hi).alias("hi")).withColumn("_b", _buckets("lo", "hi"))
        p = t.select("book", F.col(at).alias("at"), F.floor(F.col(at) / BUCKET).alias("_b")).distinct()
        return z.join(p, ["book", "_b"]).where("at between lo and hi").select("book", "chunk_id").distinct().withColumn(name, F.lit(True))

    out = g.join(zone("gap_lo", "start_index", "tag_start", "s"), ["book", "chunk_id"], "left").join(zone("end_index", "gap_hi", "tag_end", "e"), ["book", "chunk_id"], "left")
    yes = lambda c, edge: F.coalesce(F.col(c), F.lit(False)) & ~F.col(edge)
    return out.select("book", "chunk_id", yes("s", "is_first").alias("good_start"), yes("e", "is_last").alias("good_end"), "is_first", "is_last")


def edge_report(found: DataFrame) -> DataFrame:
    """Per book: boundary preservation (bpr_start, bpr_end), violations and their rate (SP-4, SP-5)."""
    broken = ~F.col("good_end") & ~F.lead("good_start").over(_book()) & ~F.col("is_last")
    rows = found.withColumn("broken", F.coalesce(broken, F.lit(False)))
    n = F.count("*") - 1
    rate = lambda c: F.try_divide(F.count_if(c), n)
    return rows.groupBy("book").agg(n.alias("total_boundaries"), F.count_if("good_start").alias("good_start"), F.count_if("good_end").alias("good_end"), rate("good_start").alias("bpr_start"), rate("good_end").alias("bpr_end"), F.count_if("broken").alias("violations"), rate("broken").alias("violation_rate"))


def orphans(chunks: DataFrame, tags: DataFrame) -> DataFrame:
    """Chunks that no tracked tag meets (SP-6)."""
    return chunks.join(overlaps(chunks, tags).select("book", "chunk_id").distinct(), ["book", "chunk_id"], "left_anti")
