"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from skein.plans.registry import ORACLE_SQL, QUERIES
from skein.plans.surrogates import DERIVED, oracle

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
#: A few of each kind; a graph walk runs many small jobs.
CHOSEN = [n for i, n in enumerate(sorted(ORACLE_SQL)) if i % 6 == 0 or n in ("g01_bfs", "r01_hybrid_recall", "j05_interval_join", "f08_rule_gate", "a09_session_costs", "p01_forget_pass", "x01_debounce", "c24_json_patch")]


def same(x):
    if hasattr(x, "__len__") and not isinstance(x, str):
        return str(list(x))
    if pd.isna(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) or type(x).__module__ == "numpy" and not isinstance(x, str) and "datetime" not in type(x).__name__ else str(x)


def table(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(same(x) for x in r) for r in df[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    assert table(QUERIES[name](spark, SMALL).toPandas()) == table(duck.execute(ORACLE_SQL[name]).df())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_derived_tables_come_before_their_use():
    text = oracle("SELECT * FROM {task_deps} WHERE x = '{2}'")
    assert text.index("tasks AS (") < text.index("task_deps AS (") < text.index("SELECT * FROM task_deps") and "{2}" in text
    assert set(DERIVED) and oracle("SELECT 1 FROM {region}") == "SELECT 1 FROM region"
