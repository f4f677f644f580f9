"""A direct-context run, what it writes, and the service clients against a local server."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from scoreloom.plans import direct, inference
from scoreloom.sources import services
from scoreloom.sources.answers import direct_answers
from scoreloom.sources.stored import stored
from scoreloom.sources.workbook import read_workbook

LONG = "vendor/a-model-with-a-very-long-name:70b"


def reply(record):
    if record["question_number"] == 2:
        raise ValueError("broken")
    return {"answer": "Answer: x\nCount: 1", "native_thinking": "hm" if record["model_name"] == "m" else "", "prompt_eval_count": 40000, "created_at": "now"}


@pytest.fixture(scope="module")
def run(spark):
    questions = spark.createDataFrame([(1, "Who?"), (2, "Which?"), (3, "Where?")], "question_number int, question string")
    lines = spark.createDataFrame([(2, "two"), (1, "one")], "row_id int, line string")
    gold = spark.createDataFrame([(1, "never said"), (9, "of no question")], "question_number int, golden_answer string")
    models = ["m", LONG, LONG + "-q4"]
    rows = stored(direct.direct_run(questions, lines, "rules", models, reply, lambda df, _: stored(df), gold))
    summary = direct.direct_summary(rows, spark.createDataFrame([(m,) for m in [*models, "gone"]], "model_name string"))
    return questions, lines, gold, models, rows, summary


def test_rows_and_summary(run):
    *_, rows, summary = run
    assert rows.count() == 9 and rows.filter("status = 'error' AND response_char_count = 0 AND notes <> '' AND error_message = 'ValueError: broken'").count() == 3
    assert {r.golden_answer for r in rows.filter("question_number = 1").collect()} == {"never said"}
    by = {r.model_name: r for r in summary.collect()}
    assert by["gone"].status == "failed" and by["gone"].error_count == 3 and by["gone"].completed_answers == 0 and "failed" in by["gone"].notes
    assert by["m"].status == "runtime_unstable" and by["m"].context_status == "valid_full_context" and by["m"].prompt_eval_count_median == 40000 and "40000" in by["m"].notes
    assert list(summary.columns) == list(direct.SUMMARY_COLUMNS)


def test_tables_and_files(run, spark, tmp_path):
    questions, lines, gold, models, rows, summary = run
    tables = direct.generation_tables(questions, gold, rows, summary, models)
    names = [n for n in tables if n not in ("run_summary", "questions", "golden_answers", "native_thinking")]
    assert len(names) == 3 and max(map(len, names)) <= 31 and "native_thinking" in tables
    assert {r.question_number: r.question for r in tables["golden_answers"].collect()} == {1: "Who?", 9: ""}
    assert tables["m"].columns == list(direct.ANSWER_COLUMNS) and tables["m"].count() == 3
    for _ in range(2):  # anew, not appended
        direct.write_run(tables, rows, lines, str(tmp_path / "out"))
    assert read_workbook(spark, str(tmp_path / "out" / "workbook.xlsx"), "*", "question_number int").count() == sum(df.count() for df in tables.values())
    assert read_workbook(spark, str(tmp_path / "out" / "workbook.xlsx"), "golden_answers").columns == ["question_number", "question", "golden_answer"]
    back = direct_answers(spark, str(tmp_path / "out" / "raw_json"))
    assert back.count() == 9 and back.filter("model_name = 'm' AND status = 'ok' AND response LIKE 'Answer: x%'").count() == 2
    assert [r.value for r in spark.read.text(str(tmp_path / "out" / "kb_full")).collect()] == ["one", "two"]
    logged = [r.value for r in spark.read.text(str(tmp_path / "out" / "logs" / "safe_model_name=m")).collect()]
    assert len(logged) == 3 and logged[1].startswith("Q2 error") and "ValueError: broken" in logged[1]
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out" / "raw_csv")).count() == 9


def test_no_thinking_no_sheet_and_long_cells(run, spark):
    questions, _, gold, _, rows, summary = run
    long = rows.filter(F.col("model_name") == "m").withColumns({"native_thinking": F.lit(""), "model_response": F.repeat(F.lit("x"), 40000)})
    tables = direct.generation_tables(questions, gold, long, summary, ["m"])
    cell = tables["m"].first().model_response
    assert "native_thinking" not in tables and cell.endswith(direct.WORKBOOK_MARK) and len(cell) <= 32767


def test_a_knowledge_table_too_large_for_a_prompt(spark):
    lines = spark.createDataFrame([(1, "abc"), (2, "def")], "row_id int, line string")
    assert direct.context_text(lines, 8) == "abc\ndef"
    with pytest.raises(ValueError):
        direct.context_text(lines, 7)
    assert direct.context_text(lines.limit(0)) == ""


@pytest.fixture()
def service():
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append(body)
            plain = body["model"] == "plain" and "think" in body
            self.send_response(400 if plain else 500 if body["model"] == "down" else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": " hi ", "thinking": None, "prompt_eval_count": 7, "message": {"content": " {} "}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", got
    server.shutdown()


def test_generate(service, spark):
    url, got = service
    client = services.Generate(url, num_ctx=99, timeout=20)
    out = client({"model_name": "plain", "prompt": "p"})
    assert out["answer"] == "hi" and out["native_thinking"] == "" and out["prompt_eval_count"] == 7
    assert [("think" in b, b["options"]) for b in got] == [(True, {"temperature": 0, "seed": 42, "num_ctx": 99}), (False, {"temperature": 0, "seed": 42, "num_ctx": 99})]
    rows = direct.asked(spark.createDataFrame([("a", "p"), ("down", "p")], "model_name string, prompt string"), client).collect()
    assert {r.model_name: (r.status, r.answer, r.prompt_eval_count) for r in rows} == {"a": ("ok", "hi", 7), "down": ("error", None, None)}


def test_chat(service, spark):
    url, got = service
    client = services.Chat(url, "m", {"map": ("be terse", "{question} of {batch_id}")}, timeout=20)
    asked = spark.createDataFrame([("q", "b1", "map")], "question string, batch_id string, stage string")
    assert inference.called(asked, client).first().output == "{}"
    assert [m["content"] for m in got[0]["messages"]] == ["be terse", "q of b1"]
