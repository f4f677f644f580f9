"""Logs of changing shape as VARIANT columns."""

import json

import pytest
from pyspark.sql import functions as F

from scoreloom.sources import varying

LINES = [
    {"model_name": "a", "question_number": 1, "model_response": "x", "status": "ok", "prompt_eval_count": 9_007_199_254_740_993 % 2**31, "new": {"deep": [1, None, {"k": "v"}]}, "big": 9_007_199_254_740_993},
    {"model_name": " ", "model": "b", "question_number": "2", "response": "y", "prompt_eval_count": "many", "status": None},
    {"arm": "mine", "model": "c", "q_id": "none", "reduce_answer": "z", "reduce_status": "ok", "ollama": {"reduce_prompt_eval_count": 7}, "diagnostics": {"n_map_failed": 3}, "map": []},
    {"model": "d", "q_id": 4, "reduce_answer": "", "config": {"reduce_num_ctx": 8192}},
]


@pytest.fixture
def path(tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "v1.jsonl").write_text("\n".join(map(json.dumps, LINES[:2])) + "\n\n{\"model\": \"cut o")
    (tmp_path / "log" / "v2.jsonl").write_text("\n".join(map(json.dumps, LINES[2:])) + "\n[1, 2]\n3\n")
    return str(tmp_path / "log")


def test_versions_are_one_table(spark, path):
    rows = {r.model_name: r for r in varying.varying_answers(varying.varying_log(spark, path)).drop("record").collect()}
    assert set(rows) == set("abcd")
    assert (rows["a"].arm, rows["a"].question_number, rows["a"].response, rows["a"].status) == ("direct_context", 1, "x", "ok")
    assert (rows["b"].question_number, rows["b"].response, rows["b"].prompt_eval_count, rows["b"].status) == (2, "y", None, None)
    assert (rows["c"].arm, rows["c"].question_number, rows["c"].response, rows["c"].prompt_eval_count, rows["c"].map_failed_count) == ("mine", None, "z", 7, 3)
    assert (rows["d"].arm, rows["d"].question_number, rows["d"].response, rows["d"].num_ctx_requested) == ("batchwise_map_reduce", 4, None, 8192)
    assert varying.varying_log(spark, path).filter("record IS NULL").count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        varying.varying_log(spark, path, strict=True).select(F.to_json("record")).collect()
    assert sum(r.records for r in varying.shapes(varying.varying_log(spark, path)).collect()) == 6


def test_what_no_column_knows_is_written_again(spark, path, tmp_path):
    log = varying.varying_log(spark, path)
    kept = varying.varying_answers(log).select("record")
    varying.write_varying(kept, str(tmp_path / "same"))
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "same")).collect()]
    same = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(same, back)) == sorted(map(same, LINES))
    varying.write_varying(varying.varying_answers(log).select("record", "arm", (F.col("question_number") + 1).alias("question_number"), F.array(F.lit("t")).alias("tags")), str(tmp_path / "more"))
    more = {r.get("model_name", "").strip() or r["model"]: r for r in (json.loads(r.value) for r in spark.read.text(str(tmp_path / "more")).collect())}
    assert more["a"] == LINES[0] | {"arm": "direct_context", "question_number": 2, "tags": ["t"]}
    assert more["c"]["q_id"] == "none" and more["c"]["arm"] == "mine" and "question_number" not in more["c"] and more["b"]["question_number"] == 3
