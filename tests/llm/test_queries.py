"""The thin queries with SQL against DuckDB, and the columns of all."""

from pathlib import Path

import duckdb
import pytest

from lectern.llm import queries as Q

COLUMNS = {
    "op1": {"doc_id", "held_out", "score", "predicted"}, "op2": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"}, "op4": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5": {"doc_id", "text"}, "op6": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op7": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op8": {"doc_id", "held_out", "lang_pred", "score"}, "op9": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op10": {"page_id", "state", "source_page_id"},
}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark, sf_dir):
    if not Path(sf_dir).is_dir():
        pytest.skip("the test tables are not here")
    df = Q.QUERIES[name](spark, sf_dir)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert got
    if name in Q.ORACLES:
        c = duckdb.connect()
        for t in ("documents", "pages"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        cursor = c.execute(Q.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert got == sorted(repr(tuple(r[names.index(x)] for x in columns)) for r in cursor.fetchall())
