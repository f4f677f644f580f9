"""Queries whose keys outgrow what the small tables have: the SQL's rows still."""

import glob
import importlib
import os
import time

import duckdb
from pyspark.sql import functions as F

from .test_queries import plain

entry = importlib.import_module("__spark_entry__")


def tables(folder, sf, **grown):
    """A folder of the small tables, those named made anew by SQL over them."""
    os.makedirs(folder)
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        if name in grown:
            duckdb.sql(f"COPY (WITH small AS (SELECT * FROM '{path}') {grown[name]}) TO '{folder}/{name}.parquet'")
        else:
            os.symlink(path, f"{folder}/{name}.parquet")
    return str(folder)


def against_sql(name, spark, folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, want = entry.queries()[name](spark, folder), connection.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    return plain(df.select(*columns).collect()), plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def moved(key: str, by: str) -> str:
    """The small table's rows once for each of the numbers given, its key moved on by them."""
    return f"SELECT {key} + i AS {key}, small.* EXCLUDE ({key}) FROM small, (SELECT unnest({by}) AS i)"


def test_batches_beyond_three_digits(spark, sf, tmp_path):
    """A thousand batches and more: labels of three digits are shared, as in the SQL."""
    got, want = against_sql("batches_of_rows", spark, tables(tmp_path / "t", sf, supplier=moved("s_suppkey", "range(0, 26000, 10)")))
    assert got == want


def test_a_row_has_the_id_that_answers_make_up(spark, sf, tmp_path):
    """Row 9999 exists: an answer that cites no row still cites none."""
    got, want = against_sql("judge_context", spark, tables(tmp_path / "t", sf, supplier=moved("s_suppkey", "[0, 9990]")))
    assert got == want


def test_seconds_of_events_beyond_a_million(spark, sf, tmp_path):
    got, want = against_sql("tolerant_parsing", spark, tables(tmp_path / "t", sf, events=moved("event_id", "[0, 999500, 7000000]")))
    assert got == want


def test_row_ids_beyond_four_digits(spark, sf, tmp_path):
    """Ids of five digits are read whole, and the row whose id answers make up counts where it is cited rightly; names repeat from key 100,000 on."""
    got, want = against_sql("row_id_consistency", spark, tables(tmp_path / "t", sf, supplier=moved("s_suppkey", "[0, 9990, 10000, 30000, 100000]")))
    assert got == want


def test_nearest_of_very_many_like_names(spark):
    """Names that differ in their digits alone: misspelled ones find their own without a comparison of all with all."""
    from scoreloom.operators import mentions as me

    names = spark.range(20000).selectExpr("concat('firm', lpad(id, 5, '0'), ' technologies corp') AS kb_key", "concat('Firm', lpad(id, 5, '0')) AS Company", "cast(id AS int) AS kb_ord")
    keys = names.filter("kb_ord % 3 = 0").selectExpr("concat(substr(kb_key, 1, 9), 'x', substr(kb_key, 10)) AS cand_key")
    far = spark.createDataFrame([("ferm00x07 technologies corp",), ("zyqwortex brumvald",), ("firm00012 technologies corp",)], "cand_key string")
    began = time.monotonic()
    got = {r.cand_key: r for r in me.nearest(keys.unionByName(far), names).collect()}
    assert time.monotonic() - began < 120
    assert len(got) == 6667 + 2 and all(got[k].near == f"Firm{k[4:9]}" for k in got if "x " in k)
    assert got["firm00012 technologies corp"].score == 1 and got["ferm00x07 technologies corp"].near == "Firm00007"
    few = names.filter("kb_ord < 30")
    some = keys.unionByName(far).filter("cand_key < 'firm00040'")
    want = {r.cand_key: (r.near, r.score) for r in me.nearest_of_all(some, few).filter("score >= 0.82").collect()}
    assert {r.cand_key: (r.near, r.score) for r in me.nearest(some, few).collect()} == want


def test_field_values_that_many_companies_have(spark):
    """Each value is looked for once in a long answer, its tokens among those of the text."""
    from scoreloom.operators import scoring as sc

    kb = spark.range(4000).selectExpr("cast(id + 1 AS int) AS row_id", "concat('c', id) AS Company", "concat('Town ', id % 50, ', Nowhere') AS Location", "id % 7 AS Employment")
    said = " ".join(f"w{k}" for k in range(60000)) + " town 7, nowhere town 33"
    answers = kb.groupBy().agg(F.collect_list("Company").alias("gold_companies")).select(F.lit(1).alias("k"), F.lit(said).alias("response"), "gold_companies", F.array(F.lit("Location"), F.lit("Employment")).alias("requested_fields"))
    began = time.monotonic()
    got = sc.field_checks(answers, ["k"], kb, ["Location", "Employment"]).groupBy("field", "expected_values").agg(F.count("*").alias("n"), F.max("field_value_score").alias("most"), F.min("field_value_score").alias("least")).collect()
    assert time.monotonic() - began < 20
    towns = {r.expected_values: (r.n, r.most, r.least) for r in got if r.field == "Location"}
    assert len(towns) == 50 and towns["Town 7, Nowhere"] == (80, 1, 1) and towns["Town 8, Nowhere"] == (80, 1, 1)
    assert sum(r.n for r in got) == 8000


def test_exploded_names_are_not_broadcast(spark, sf):
    """The rows that names are exploded into are merged, whatever Spark takes their size for."""
    text = entry.queries()["near_spelling_by_distance"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in text.splitlines() if "Join" in line and "__short" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_a_check_for_each_row_of_a_name(spark, sf, tmp_path):
    """Names of six-digit keys repeat; every row of a nation is checked."""
    got, want = against_sql("field_value_checks", spark, tables(tmp_path / "t", sf, supplier=moved("s_suppkey", "[0, 10000, 100000, 100005, 100020]")))
    assert got == want
