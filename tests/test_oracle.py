"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others give rows of a stable schema."""

import os
import re

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CORE = sorted(n for n in entry.oracle_sql() if not re.match(r"op\d|pipeline", n))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, bool) or isinstance(v, str):
            return str(v)
        if pd.isna(v):
            return "null"
        return f"{float(v):.6g}"

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CORE)
def test_equals_sql(spark, duck, data, name):
    got = entry.queries()[name](spark, data).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", ["adaptive_run", "lower_bound_run", "adwin_detections", "hoeffding_tree_log", "sketch_rows", "window_information", "circular_pattern", "generated_stream"])
def test_stateful_queries_run(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and "kappa_m" in df.columns
