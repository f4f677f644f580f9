"""Every registered query with SQL gives the SQL's rows on the smallest tables; plans are what they should be."""

import glob
import importlib
import math
import os
import re

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
ORACLES = {n: s for n, s in entry.oracle_sql().items() if not n.startswith("op") and n != "pipeline"}


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(rows):
    def value(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf, duck):
    df = entry.queries()[name](spark, sf)
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert plain(df.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def plan(name, spark, sf):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, sf):
    text = plan("revenue_by_area", spark, sf)
    assert "LessThan(l_shipdate" in text and "l_comment" not in text and "l_tax" not in text


@pytest.mark.parametrize("name", ["entity_extraction", "phrases_in_documents", "leakage_guard", "set_prf_by_group", "two_memberships", "best_row_per_group"])
def test_no_comparison_of_all_with_all(name, spark, sf):
    text = plan(name, spark, sf)
    assert "CartesianProduct" not in text and "Python" not in text


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns[:2] == ["arm", "model_name"]


def test_nothing_else_needs_the_training_data_package():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/scoreloom/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"\bllm\b", open(path).read()), path
