"""The registered queries: SQL where there is some, whole tables, and columns of the contracts."""

import duckdb
import pytest

from recurra.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_topk": {"query_id", "rank", "vec_id", "score"},
    "op2_simhash": {"doc_id", "fingerprint", "component_id"},
    "op4_langid": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_urls": {"page_id", "host", "path", "rule", "verdict"},
    "op7_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op8_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op9_chat": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op10_mixing": {"doc_id", "size", "source_size", "target", "taken"},
}


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, data)
    assert set(df.columns) == set(columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, data, name):
    df = QUERIES[name](spark, data)
    assert COLUMNS[name] <= set(df.columns)
    table = {"op1_topk": None, "op5_urls": "pages", "op9_chat": None}.get(name, "documents")
    if table:
        assert df.count() == spark.read.parquet(f"{data}/{table}.parquet").count()
