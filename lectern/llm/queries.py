"""The thin queries over the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, language_id, media, minhash, packing, pii, quality_classifier, quality_rules, token_store, tokens, warc
from lectern.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(read_table(spark, sf_dir, "documents"))


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


@_query
def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_inspect(read_table(spark, sf_dir, "documents"))


@_query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), tokens.vocabulary_path("byte_bpe_50k.json"))


@_query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link_components(read_table(spark, sf_dir, "documents"), size=3, percent=85)


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokens.vocabulary_path("byte_bpe_50k.json"))


@_query
def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(read_table(spark, sf_dir, "documents"), tokens.vocabulary_path("word_bpe_49k.json"))


@_query
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_surrogates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


@_query
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits(read_table(spark, sf_dir, "pages"))


ORACLES["op10_warc_revisits"] = warc.REVISITS_SQL


_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op2_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split(translate(t, {_BLANKS}, '     '), ' '), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: translate(x, ' ' || {_BLANKS}, '') <> '') AS lines FROM d),
windows AS (SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1) GROUP BY 1),
m AS (SELECT w.doc_id, len(w) AS n_words, length(translate(t, ' ' || {_BLANKS}, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS upper_, length(regexp_replace(t, '[^\p{{Ll}}]', '', 'g')) AS lower_,
  len(list_filter(w, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS dots FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 5 * n_lines OR 10 * lettered < 7 * n_words OR upper_ > lower_ OR 10 * dots > 3 * n_words) AS kept
FROM b
"""
