"""Calls of clients: values that arrive and come back as they are, limits, and the ledger."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from scoreloom.plans import direct, inference, judge
from scoreloom.plans.calls import Limits, answered, answered_once

BIG = 9_007_199_254_740_993


def test_values_are_exact_whatever_is_null_beside(spark):
    rows = [(BIG, 1, ["a", None], {"x": 1}, None), (None, None, None, None, 2.5), (BIG + 2, 3, [], {}, float("nan"))]
    df = spark.createDataFrame(rows, "id long, n int, tags array<string>, m map<string,int>, d double").coalesce(1)
    out = inference.called(df, lambda r: repr((r["id"], r["n"], r["tags"]))).orderBy(F.col("id").asc_nulls_last()).collect()
    assert [r.output for r in out] == [repr((BIG, 1, ["a", None])), repr((BIG + 2, 3, [])), repr((None, None, None))]
    assert [r.id for r in out] == [BIG, BIG + 2, None] and out[0].n == 1 and out[0].m == {"x": 1} and out[1].d != out[1].d
    asked = direct.asked(df, lambda r: {"answer": str(r["id"]), "eval_count": 7.0 if r["id"] else None, "total_duration": BIG}).collect()
    assert {(r.id, r.answer, r.eval_count, r.total_duration) for r in asked} == {(BIG, str(BIG), 7, BIG), (None, "None", None, BIG), (BIG + 2, str(BIG + 2), 7, BIG)}
    made = judge.judged(df.withColumn("response", F.lit("x")), lambda m, case: (case["id"] % 2, m), metrics=("one", "two")).collect()
    assert {(r.id, r.one, r.status) for r in made} == {(BIG, 1.0, "ok"), (BIG + 2, 1.0, "ok"), (None, None, "partial_error")}


def test_calls_run_side_by_side_within_limits(spark):
    df = spark.range(40).coalesce(1)
    slow = lambda r: time.sleep(0.1) or str(r["id"])
    began = time.time()
    assert {r.output for r in inference.called(df, slow, limits=Limits(in_flight=20)).collect()} == {str(i) for i in range(40)}
    assert time.time() - began < 3.5
    began = time.time()
    inference.called(spark.range(10).coalesce(1), lambda r: "", limits=Limits(in_flight=5, per_second=20)).collect()
    assert time.time() - began > 0.4
    late = inference.called(df, slow, limits=Limits(until=time.time() - 1)).collect()
    assert all(r.call_status == "error" and "TimeoutError" in r.error for r in late)


def counted(folder, fail_first=()):
    """A client that leaves a file for each call; kills its worker once at the ids named."""

    def client(record):
        open(f"{folder}/{record['id']}-{time.time_ns()}", "w").close()
        if record["id"] in fail_first and not os.path.exists(f"{folder}/../died-{record['id']}"):
            open(f"{folder}/../died-{record['id']}", "w").close()
            os._exit(1)
        return f"answer {record['id']}"

    return client


def calls(folder):
    return sorted(int(n.split("-")[0]) for n in os.listdir(folder))


def test_a_run_that_ends_half_way_is_gone_on_with(spark, tmp_path):
    seen, ledger = tmp_path / "seen", f"file://{tmp_path}/ledger"
    seen.mkdir()
    prompts = spark.range(12).coalesce(1).withColumn("text", F.lit("hi"))
    with pytest.raises(Exception, match="(?i)worker|crash|exit"):  # local mode: a task has one attempt
        inference.called(prompts, counted(str(seen), (7,)), ledger=ledger)
    first = calls(seen)
    assert 7 in first and len(first) == len(set(first))
    out = inference.called(prompts.unionByName(prompts), counted(str(seen)), ledger=ledger)
    assert sorted(r.output for r in out.collect()) == sorted([f"answer {i}" for i in range(12)] * 2)
    assert calls(seen) == sorted([*range(12), 7])  # only the call that died is made again
    again = inference.called(prompts, counted(str(seen)), ledger=ledger)
    assert again.count() == 12 and len(calls(seen)) == 13


def test_second_attempts_read_the_first_ones_answers(tmp_path):
    """What a part's earlier attempt has written, in the folder of its run, isn't asked again."""
    from scoreloom.plans.calls import _Journal

    one = _Journal(f"file://{tmp_path}/run/3", 1)
    one.add("k1", {"output": "x"}, True)
    (tmp_path / "run" / "3" / "torn.json").write_text('{"call_key": "k2", "ok": tr')
    two = _Journal(f"file://{tmp_path}/run/3", 4)
    assert two.known == {"k1": {"output": "x"}}
    two.add("k3", {"output": "ä"}, False)
    assert len(os.listdir(tmp_path / "run" / "3")) == 2
    two.flush()
    assert _Journal(f"file://{tmp_path}/run/3", 1).known["k3"] == {"output": "ä"}


def test_failures_are_asked_again_in_the_next_run_only(spark, tmp_path):
    ledger, flag = f"file://{tmp_path}/l", tmp_path / "up"

    def ask(record, begin):
        begin()
        return {"value": record["id"] * 2, "status": "ok" if flag.exists() or record["id"] else "down", "parts": ["a", None]}

    ok = lambda reply: reply["status"] == "ok"
    schema = "value long, status string, parts array<string>"
    df = spark.createDataFrame([(0, None), (BIG, "x"), (None, None)], "id long, `odd name` string").filter("id is not null")
    first = answered_once(df, ask, schema, ledger, ok).collect()
    assert {(r.id, r.value, r.status) for r in first} == {(0, 0, "down"), (BIG, 2 * BIG, "ok")} and first[0].parts == ["a", None]
    flag.touch()
    assert {r.status for r in answered_once(df, ask, schema, ledger, ok).collect()} == {"ok"}
    lines = [json.loads(x) for f in tmp_path.glob("l/**/*.json") for x in f.read_text().splitlines()]
    assert len(lines) == 3
    assert answered(df.limit(0), ask, schema).count() == 0 and answered_once(df.limit(0), ask, schema, ledger, ok).count() == 0
