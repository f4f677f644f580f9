"""Runs whose answers arrive one after the other stand in the end as the finished log says."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.plans import inference
from scoreloom.streaming import runs, scores

SCHEMA = "model_name string, question_number int, status string, prompt_eval_count int, runtime_seconds double, num_ctx int, approx_tokens int, ts timestamp"


@pytest.fixture(scope="module")
def rocks(spark):
    """The session with the state store that keyed state needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def answers(seed):
    rand, out = random.Random(seed), []
    for model, bad, tokens in (("good", 0.0, None), ("shaky", 0.5, None), ("some", 0.1, None), ("dead", 1.0, None), ("capped", 0.0, 4096), (None, 0.2, None)):
        for q in range(rand.randint(9, 30)):
            failed = rand.random() < bad
            out.append((model, q, "error" if failed else "ok", None if failed or rand.random() < 0.05 else tokens or 4000 + rand.randrange(7), None if failed else rand.random(), 65536, 4100, f"2024-01-01T00:{q:02d}:30Z"))
    return out


def test_runs_end_as_the_finished_log_says(rocks, tmp_path):
    rows = answers(1)
    arriving = sorted(rows + random.Random(2).sample(rows, 20), key=lambda r: r[-1])  # some arrive twice
    arriving.append(("late", 1, "ok", 4000, 1.0, 65536, 4100, "2024-01-01T09:00:00Z"))
    (tmp_path / "in").mkdir()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for k in range(0, len(arriving), 25):
        (tmp_path / "in" / f"{k:06d}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in arriving[k : k + 25]))
        os.utime(tmp_path / "in" / f"{k:06d}.json", (1_700_000_000 + k,) * 2)  # files are taken by their time
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = runs.run_states(stream, expected=12).writeStream.foreachBatch(lambda df, k: df.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update")
    query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = rocks.read.parquet(str(tmp_path / "out"))
    ended = {r.model_name: r for r in out.filter("ended").collect()}
    want = {r.model_name: r for r in inference.run_summary(rocks.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string"))).collect()}
    assert ended.keys() == want.keys() and "late" not in ended
    for model, w in want.items():
        e = ended[model]
        same = ["total_questions", "completed_answers", "error_count", "prompt_min", "prompt_median", "prompt_max", "context_status"]
        assert [e[c] for c in same] == [w[c] for c in same]
        assert e.run_status == (w.run_status if w.total_questions >= 12 else "failed")
        assert e.average_seconds == pytest.approx(w.average_seconds) if w.average_seconds is not None else e.average_seconds is None
    assert out.filter("NOT ended").count() > len(want)  # they said how they stood on the way
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 20  # what has ended is given up
    assert {r.model_name for r in out.filter("ended").collect()} >= {None, "dead"} and ended["dead"].run_status == "failed"


def test_status_of_numbers_equals_that_of_columns(spark):
    cases = [(c, e, c + e + x) for c in range(4) for e in range(5) for x in range(3)]
    df = spark.createDataFrame(cases, "c int, e int, t int").withColumn("s", inference.run_status(F.col("c"), F.col("e"), F.col("t")))
    assert all(r.s == runs.run_status_of(r.c, r.e, r.t) for r in df.collect())


def test_scores_with_a_time_keep_bounded_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(6):
        lines = [{"arm": "a", "model_name": "m", "question_number": k, "status": "ok", "response": "Count: 1", "at": f"2024-01-0{k + 1}T00:00:00Z"}] * 2
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, lines)))
        os.utime(tmp_path / "in" / f"{k}.json", (1_700_000_000 + k,) * 2)
    stream = spark.readStream.schema("arm string, model_name string, question_number int, status string, response string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = scores.keep_scores(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ts="at", late="1 day")
    query.awaitTermination()
    assert sorted(r.question_number for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(6))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] < 4


def test_questions_are_told_apart_in_shared_entries():
    """Neighbouring questions share an entry of state; each is new once, across frames, writes and entries, few or many."""
    import numpy as np

    class Asked(dict):
        def containsKey(self, key):  # noqa: N802
            return key in self

        def getValue(self, key):  # noqa: N802
            return self[key]

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

    run, seen, rand = runs._Run(0, 0), set(), np.random.default_rng(5)
    run.asked = Asked()
    for most in (20, 9000, 9000, 1 << 31):
        held = {}
        for _ in range(3):
            questions = rand.integers(-1, most, 3000)
            want = [not (q in seen or seen.add(q)) for q in questions.tolist()]
            assert run._new(questions, held).tolist() == want
        run._write(held)
    assert len(run.asked) < len(seen)
