"""A direct-context run from questions to stored answers, their summary, and the tables and logs that a run leaves."""

from __future__ import annotations

import time
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capped_cell, half_even, safe_name
from ..sources.answers import DIRECT_SCHEMA, fixed_columns, write_tables
from ..sources.workbook import write_workbook
from .calls import Limits, answered, answered_once
from .inference import run_summary

#: Gives a text, or a dict of the fields of REPLY.
Client = Callable[[dict], str | dict]
REPLY = "answer string, native_thinking string, prompt_eval_count int, eval_count int, total_duration bigint, load_duration bigint, prompt_eval_duration bigint, eval_duration bigint, created_at string"
REPLY_FIELDS = tuple(part.split()[0] for part in REPLY.split(", "))
# The columns of an answer's row and of a run's summary.
ANSWER_COLUMNS = (
    "question_number", "question", "golden_answer", "model_name", "model_response", "status", "error_message", "num_ctx_requested", "actual_context_observed_if_available",
    "prompt_eval_count", "eval_count", "total_duration", "load_duration", "prompt_eval_duration", "eval_duration", "created_at", "prompt_hash", "kb_hash",
    "question_hash", "response_char_count", "notes",
)
SUMMARY_COLUMNS = (
    "model_name", "safe_model_name", "total_questions", "completed_answers", "error_count", "context_status", "num_ctx_requested", "prompt_eval_count_min",
    "prompt_eval_count_median", "prompt_eval_count_max", "total_runtime_seconds", "average_runtime_seconds", "status", "notes",
)
SHEET_NAME = 31
# Fixed value: what stands at the end of a cut cell.
WORKBOOK_MARK = "...[TRUNCATED FOR EXCEL; see raw_json]"
#: A knowledge table is part of every prompt, so that no larger one can be sent to any model.
MOST_CHARACTERS = 16_000_000


def context_text(lines: DataFrame, most: int = MOST_CHARACTERS) -> str:
    """The lines (row_id, line) in their order as one text; an error, before anything is gathered, beyond `most` characters."""
    size = lines.agg(F.sum(F.length("line") + 1).alias("n")).first()["n"] or 0
    if size > most:
        raise ValueError(f"the knowledge table has {size} characters, a prompt holds {most} at most")
    gathered = F.array_sort(F.collect_list(F.struct("row_id", "line")))
    return lines.agg(F.array_join(F.transform(gathered, lambda s: s["line"]), "\n").alias("text")).first()["text"]


def stripped(c: str) -> Column:
    """The text without white space of any kind at its ends; null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def asked(prompts: DataFrame, client: Client, limits: Limits = Limits(), ledger: str | None = None, prompt_of: Callable[[dict], dict] | None = None) -> DataFrame:
    """prompts with the reply's fields, status (ok, error), error_message and seconds; a failure is a row, and the rest
    goes on. With a ledger no prompt that has a good reply there is asked again.

    prompt_of: makes prompt, prompt_hash and approx_tokens of a row where it is asked, so that no prompt is moved; the
    last two are columns of the result then."""

    def ask(record: dict, begin: Callable[[], None]) -> dict:
        began, made = time.monotonic(), prompt_of(record) if prompt_of else {}
        try:
            begin()
            reply = client(record | made)
            reply = {f: reply.get(f) for f in REPLY_FIELDS} if isinstance(reply, dict) else {"answer": reply}
            end = {"status": "ok", "error_message": None}
        except Exception as e:  # noqa: BLE001  any failure of a client is a failed row
            reply, end = {}, {"status": "error", "error_message": f"{type(e).__name__}: {e}"}
        return reply | end | {k: v for k, v in made.items() if k != "prompt"} | {"seconds": time.monotonic() - began}

    made = f"{REPLY}, status string, error_message string, seconds double" + (", prompt_hash string, approx_tokens int" if prompt_of else "")
    if ledger:
        return answered_once(prompts, ask, made, ledger, lambda reply: reply["status"] == "ok", limits)
    return answered(prompts, ask, made, limits)


def direct_run(
    questions: DataFrame, lines: DataFrame, rules: str, models: list[str], client: Client, keep: Callable[[DataFrame, str], DataFrame], gold: DataFrame | None = None, num_ctx: int = 65536,
    limits: Limits = Limits(), ledger: str | None = None,
) -> DataFrame:
    """A row a model and question with ANSWER_COLUMNS, native_thinking, approx_tokens and seconds.

    questions: question_number, question; lines: row_id, line of the knowledge table; gold: question_number,
    golden_answer. A prompt with its own gold answer is an error. Only questions are dealt out over the tasks; each
    prompt is made where it is asked, of the knowledge table's text that every executor has once. keep(df, name) writes
    rows and reads them back; with a ledger no model is asked twice, whichever task or run is run again."""
    spark = questions.sparkSession
    gold = gold if gold is not None else questions.select("question_number", F.lit("").alias("golden_answer"))
    text = context_text(lines)
    shared = spark.sparkContext.broadcast((rules, text))  # bounded by context_text
    names = spark.createDataFrame([(m,) for m in models], "model_name string")
    rows = questions.select("question_number", "question").crossJoin(F.broadcast(names))  # a few models
    rows = rows.join(gold.select("question_number", "golden_answer"), "question_number", "left").withColumns({
        "golden_answer": F.coalesce("golden_answer", F.lit("")), "num_ctx_requested": F.lit(num_ctx), "question_hash": F.sha2("question", 256),
        "kb_hash": F.lit(sha256(text.encode("utf-8", "surrogatepass")).hexdigest()), "rules_hash": F.lit(sha256(rules.encode()).hexdigest()),
    })

    def prompt_of(record: dict) -> dict:
        rules, text = shared.value
        asks = [] if record["question"] is None else [f"Question: {record['question']}"]
        prompt = "\n\n".join([rules, text, *asks])
        if record["golden_answer"] and record["golden_answer"] in prompt:
            raise ValueError(f"gold answer in the prompt of question {record['question_number']}")
        return {"prompt": prompt, "prompt_hash": sha256(prompt.encode("utf-8", "surrogatepass")).hexdigest(), "approx_tokens": len(prompt) // 4}

    raw = keep(asked(rows.repartition("model_name", "question_number"), client, limits, ledger, prompt_of), "direct_answers")
    good = F.col("status") == "ok"
    answer = F.when(good, stripped("answer")).otherwise("")
    rows = raw.withColumns({
        "model_response": answer, "native_thinking": stripped("native_thinking"), "error_message": F.coalesce("error_message", F.lit("")),
        "actual_context_observed_if_available": F.col("prompt_eval_count"), "response_char_count": F.length(answer),
        "notes": F.when(good, "").otherwise("this question failed, the others were asked"),
    })
    return rows.select(*ANSWER_COLUMNS, "native_thinking", "approx_tokens", "seconds")


def _note(sent: Column) -> Column:
    mid, low = F.col("prompt_eval_count_median"), F.col("prompt_eval_count_min")
    short = F.format_string("median of %s prompt tokens for about %s sent: the context was cut", mid, sent)
    pinned = F.format_string("%s prompt tokens on every question, a cap below num_ctx", low)
    whole = F.format_string("prompt tokens: median %s, most %s (num_ctx %s)", mid, F.col("prompt_eval_count_max"), F.col("num_ctx_requested"))
    context = F.when(mid.isNull(), "no answer tells its prompt tokens").when(F.col("context_status") == "valid_full_context", whole).when(mid < 0.85 * sent, short).otherwise(pinned)
    return F.concat_ws("; ", context, F.when(F.coalesce("completed_answers", F.lit(0)) == 0, "every question failed"))


def direct_summary(rows: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """SUMMARY_COLUMNS, a row a model; models without any row have failed as a whole.

    What was sent is the size of the first question's prompt."""
    sent = rows.agg(F.min_by("approx_tokens", "question_number").alias("sent"), F.max("num_ctx_requested").alias("num_ctx_requested"), F.count_distinct("question_number").alias("asked"))
    counted = rows.drop("approx_tokens").crossJoin(F.broadcast(sent.select(F.col("sent").alias("approx_tokens"))))  # one row
    counted = counted.withColumns({"num_ctx": F.col("num_ctx_requested"), "runtime_seconds": F.col("seconds")})
    out = run_summary(counted, models).crossJoin(F.broadcast(sent))  # one row
    out = out.withColumnsRenamed({"prompt_min": "prompt_eval_count_min", "prompt_median": "prompt_eval_count_median", "prompt_max": "prompt_eval_count_max", "run_status": "status"})
    out = out.withColumns({
        "notes": _note(F.col("sent")), "safe_model_name": safe_name(F.col("model_name")), "total_questions": F.coalesce("total_questions", "asked"), "error_count": F.coalesce("error_count", "asked"),
        "completed_answers": F.coalesce("completed_answers", F.lit(0)), "total_runtime_seconds": half_even(F.col("total_seconds"), 2), "average_runtime_seconds": half_even(F.col("average_seconds"), 2),
    })
    return out.select(*SUMMARY_COLUMNS)


def generation_tables(questions: DataFrame, gold: DataFrame, rows: DataFrame, summary: DataFrame, models: list[str]) -> dict[str, DataFrame]:
    """The tables of a generation workbook: run_summary, questions, golden_answers, one a model under its cut name (a
    number behind names that would meet), and native_thinking where a model gave any. Long cells are cut."""

    def cut(df: DataFrame) -> DataFrame:
        return df.withColumns({c: capped_cell(F.col(c), WORKBOOK_MARK, 40) for c, kind in df.dtypes if kind == "string"})

    asked_of = questions.select("question_number", "question")
    answers = gold.select("question_number", "golden_answer").join(asked_of, "question_number", "left").select("question_number", F.coalesce("question", F.lit("")).alias("question"), "golden_answer")
    tables = {"run_summary": summary, "questions": asked_of, "golden_answers": cut(answers)}
    for model in models:
        name = "".join("_" if c in ":/ " else c for c in model)[:SHEET_NAME]
        if name in tables:
            name = next(n for n in (f"{name[: SHEET_NAME - len(str(i)) - 1]}~{i}" for i in range(2, len(models) + 4)) if n not in tables)
        tables[name] = cut(fixed_columns(rows.filter(F.col("model_name") == model), list(ANSWER_COLUMNS)))
    thoughts = rows.select("model_name", "question_number", "native_thinking")
    if not thoughts.filter("native_thinking <> ''").isEmpty():
        tables["native_thinking"] = cut(thoughts)
    return tables


def log_lines(rows: DataFrame, preview: int = 400) -> DataFrame:
    """(model_name, question_number, line): what a run's log says of each answer."""
    said = F.concat(
        F.format_string("Q%s ok in %.1fs, %s prompt tokens, %s characters: ", F.col("question_number"), F.col("seconds"), F.coalesce(F.col("prompt_eval_count").cast("string"), F.lit("?")), F.col("response_char_count")),
        F.translate(F.left("model_response", F.lit(preview)), "\n", " "),
    )
    failed = F.format_string("Q%s error after %.1fs: %s", F.col("question_number"), F.col("seconds"), F.col("error_message"))
    return rows.select("model_name", "question_number", F.when(F.col("status") == "ok", said).otherwise(failed).alias("line"))


def write_run(tables: dict[str, DataFrame], rows: DataFrame, lines: DataFrame, folder: str) -> None:
    """What a run leaves, anew: workbook.xlsx and workbook/<table> (CSV), raw_csv and raw_json by model, logs by model, and kb_full (JSON lines).

    raw_json has native_thinking and can be read as direct answers; the CSV tables haven't."""
    by_model = rows.withColumn("safe_model_name", safe_name(F.col("model_name")))
    write_workbook(tables, f"{folder}/workbook.xlsx")
    write_tables(tables, f"{folder}/workbook")
    kinds = dict(f.split()[:2] for f in DIRECT_SCHEMA.split(", "))
    raw = by_model.select("safe_model_name", *[c for c in (*ANSWER_COLUMNS, "native_thinking") if c in kinds])
    raw.write.mode("overwrite").partitionBy("safe_model_name").json(f"{folder}/raw_json")
    flat = by_model.select("safe_model_name", *ANSWER_COLUMNS).write.mode("overwrite").partitionBy("safe_model_name")
    flat.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(f"{folder}/raw_csv")
    logs = log_lines(by_model).withColumn("safe_model_name", safe_name(F.col("model_name"))).repartition("safe_model_name").sortWithinPartitions("safe_model_name", "question_number")
    logs.select("safe_model_name", "line").write.mode("overwrite").partitionBy("safe_model_name").text(f"{folder}/logs")
    lines.orderBy("row_id").select("line").write.mode("overwrite").text(f"{folder}/kb_full")
