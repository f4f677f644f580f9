"""The log of answers: committed rows once, after a run that dies, batches that are run again, and files of no batch."""

import os
import time

import pytest
from pyspark.sql import functions as F

from scoreloom.plans import inference
from scoreloom.sources.answer_log import LogWriter, Lines, feed, log_answers, logged_answers

SCHEMA = "id long, text string, output string, call_status string, attempts int, error string, seconds double"


def client(folder, dies=None):
    """Leaves a file a call; its worker dies at call number `dies`."""

    def ask(record):
        open(f"{folder}/{record['id']}-{time.time_ns()}", "w").close()
        if dies and len(os.listdir(folder)) == dies:
            os._exit(1)
        return f"said {record['id']} {record['text']}"

    return ask


def test_a_run_that_dies_goes_on_behind_its_last_commit(spark, tmp_path):
    seen, folder = tmp_path / "seen", f"file://{tmp_path}/run"
    seen.mkdir()
    prompts = spark.range(20).withColumn("text", F.when(F.col("id") % 2 == 0, "ä\n\"x\""))
    asked = lambda dies=None: lambda stream: inference.called(stream, client(str(seen), dies))
    assert logged_answers(spark, f"{folder}/log", SCHEMA).count() == 0
    with pytest.raises(Exception, match="(?i)stream|worker|job"):
        feed(prompts, asked(11), folder, files=10)
    first = {r.id for r in logged_answers(spark, f"{folder}/log", SCHEMA).collect()}
    assert 0 < len(first) < 11
    feed(prompts, asked(), folder, files=10)
    rows = logged_answers(spark, f"{folder}/log", SCHEMA).collect()
    assert sorted((r.id, r.text, r.output) for r in rows) == [(i, None if i % 2 else 'ä\n"x"', f"said {i} {None if i % 2 else chr(228) + chr(10) + chr(34) + 'x' + chr(34)}") for i in range(20)]
    calls = [int(n.split("-")[0]) for n in os.listdir(seen)]
    assert all(calls.count(i) == 1 for i in first)  # what was committed isn't asked again
    feed(prompts, asked(), folder, files=10)
    assert logged_answers(spark, f"{folder}/log", SCHEMA).count() == 20 and len(os.listdir(seen)) == len(calls)


def test_batches_run_again_and_runs_that_truncate(spark, tmp_path):
    spark.range(6).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    log = f"file://{tmp_path}/log"
    log_answers(stream(), log, f"{tmp_path}/c1").awaitTermination()
    assert sorted(r.id for r in logged_answers(spark, log, "id long").collect()) == list(range(6))
    (tmp_path / "log" / "data" / "stray.json").write_text('{"id": 99}\n')  # of a task whose batch was never committed
    run = next((tmp_path / "log" / "commits").iterdir()).name
    writer = LogWriter({"path": log, "run": run})
    (tmp_path / "log" / "data" / "again.json").write_text('{"id": 7}\n')
    writer.commit([Lines("again.json", 1), None, Lines("none.json", 0)], 0)  # batch 0 once more
    ids = sorted(r.id for r in logged_answers(spark, log, "id long").collect())
    assert len(ids) == 5 and 7 in ids and 99 not in ids
    writer.abort([Lines("again.json", 1), None], 0)
    assert not (tmp_path / "log" / "data" / "again.json").exists()
    log_answers(stream(), log, f"{tmp_path}/c2").awaitTermination()
    assert logged_answers(spark, log, "id long").count() == 10
    log_answers(stream(), log, f"{tmp_path}/c3", truncate=True).awaitTermination()
    assert sorted(r.id for r in logged_answers(spark, log, "id long").collect()) == list(range(6))
