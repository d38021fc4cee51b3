"""Language identification by compression.

For each language a raw-content dictionary of sample text primes a zstandard
compressor; a text belongs to the language under whose dictionary it becomes
smallest. The lead over the runner-up is the margin; narrow margins are
rejected in the column ``accepted``, while ``lang_pred`` keeps the best guess.

A dictionary helps only as far as it reaches, so a long text is taken in
blocks (``BLOCK_BYTES``, all of about one length) that cover it whole, each
compressed afresh; their sizes are summed, and margin and score don't depend on
how long the text is.

Texts reach Python in batches that end with the row which goes past ``BATCH_BYTES``, so
that memory is bounded by that and the longest text; the result, without texts,
is written to the shared folder.

The dictionaries hold at most ``dictionary_bytes`` of at most ``rows_per_lang``
texts a language (documented bounds); every whole text is classified.

Matches of three bytes count (an optimal parser finds them), since the words of
a language share short pieces.

Defined results: a null text or one without a letter (Unicode's categories L) is ``und`` with score 0;
ties go to the language with more learned documents, then to the first by name; repeated rows get equal results; with
no language to learn everything is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_batches, held_out, stored

ROWS_PER_LANG, DICTIONARY_BYTES = 400, 32 * 1024
#: Bytes of a text that are compressed at once.
BLOCK_BYTES = 2 * 1024
#: Bytes of text that a Python worker is sent at once.
BATCH_BYTES = 4 << 20
#: Lead in bits a byte of text under which a guess is rejected.
NARROW = 0.02


def dictionaries(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Sample text of each language, from documents that aren't held out; languages with more documents come first.

    The rows are those with the smallest hashed ids; equal texts count once,
    and no text gives more than a fortieth of its dictionary, from its start.
    """
    share = dictionary_bytes // 40
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return {}
    # A share of each language by hashed id, about three times the rows needed: no text is shuffled.
    part = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3 * rows_per_lang / n))]), F.col("lang"))
    h = F.xxhash64("doc_id")
    best = known.where(F.pmod(h, F.lit(1 << 20)) < part * (1 << 20)).select("lang", h.alias("h"), F.lower(F.substring("text", 1, share)).alias("t"))
    texts: dict[str, dict[bytes, None]] = {}
    for lang, _, t in sorted(best.collect(), key=lambda r: (r[0], r[1], r[2])):
        if len(texts.setdefault(lang, {})) < rows_per_lang:
            texts[lang][t.encode()] = None
    return {lang: b"\n".join(list(texts[lang])[::-1])[-dictionary_bytes:] for lang in sorted(texts, key=lambda x: (-counts[x], x))}


def blocks(raw: bytes, most: int = BLOCK_BYTES) -> list[bytes]:
    """The whole text in blocks of ``most`` bytes at most, of equal length but for one byte."""
    n = max(1, -(-len(raw) // most))
    return [raw[len(raw) * k // n : len(raw) * (k + 1) // n] for k in range(n)]


def classified(docs: DataFrame, learned: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), margin (bits a byte) and accepted of every row."""
    langs = list(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        given = [zstd.ZstdCompressionDict(learned[x], dict_type=zstd.DICT_TYPE_RAWCONTENT) for x in langs]
        how = zstd.ZstdCompressionParameters(compression_level=3, min_match=3, strategy=zstd.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False)
        for d in given:
            d.precompute_compress(compression_params=how)
        tools = [zstd.ZstdCompressor(dict_data=d, compression_params=how) for d in given]
        for b in batches:
            pred, score, margin = [], [], []
            for t in b.column("text").to_pylist():
                if not langs or t is None or not any(map(str.isalpha, t)):
                    pred.append("und"), score.append(0.0), margin.append(0.0)
                    continue
                raw = t.lower().encode()
                parts = blocks(raw)
                sizes = sorted(((sum(len(c.compress(p)) for p in parts), x) for c, x in zip(tools, langs, strict=True)), key=lambda x: x[0])
                lead = 8 * (sizes[1][0] - sizes[0][0]) / len(raw) if len(sizes) > 1 else 8.0
                # The share of the likelihood that the best language has, each size being a code length for 40 bytes.
                rest = sum(2.0 ** (-8 * 40 * (s - sizes[0][0]) / len(raw)) for s, _ in sizes)
                pred.append(sizes[0][1]), score.append(1 / rest), margin.append(lead)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["doc_id", "lang_pred", "score", "margin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, margin double")
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        out = stored(out, "languages")
    return out.withColumn("accepted", (F.col("lang_pred") != "und") & (F.col("margin") >= narrow))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and accepted of every document, learned from those that aren't held out."""
    out = classified(docs, dictionaries(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")
