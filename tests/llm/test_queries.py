"""The registered queries: names, columns, and rows against SQL where there is some."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from millrace.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "n_licences", "families", "probability"],
    2: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    3: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    4: ["doc_id", "size", "source_size", "target", "rate", "copies", "taken"],
    5: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    6: ["doc_id", "fingerprint", "component_id"],
    7: ["vec_id", "n_links", "component_id", "kept"],
    8: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    9: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    10: ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_rows(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns == COLUMNS[int(name[2:].split("_")[0])]
    table = "embeddings" if name.startswith("op7") else "documents"
    rows = df.collect()
    assert len(rows) >= spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        rel = con.sql(queries.oracle_sql()[name])
        assert rel.columns == df.columns
        assert [{"bigint": "BIGINT", "boolean": "BOOLEAN"}[t] for _, t in df.dtypes] == list(map(str, rel.types))
        assert Counter(map(tuple, rows)) == Counter(rel.fetchall())
