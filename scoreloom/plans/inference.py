"""Batched map, verify and reduce inference, and direct-context runs, around a client that callers give.

A client is a plain callable that gets one prompt record (a dict) and returns a text. It runs on the executors, once
a row; what it returns is written before it is read again, so that later steps or lost executors don't ask anew."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, json_body, let, natural_sorted
from .calls import Limits, answered, answered_once

Client = Callable[[dict], str]
CALL_SCHEMA = "output string, call_status string, attempts int, error string, seconds double"
REPLY = "matched_row_ids array<string>, relevant_record_ids array<string>, verified_row_ids array<string>, removed_row_ids array<string>, filter_interpretation string, verification_notes string"
# Prompt sizes at which a context of the same length on every question means a silent cap.
ROUND_CONTEXTS = (2048, 4096, 8192, 16384, 32768)


def called(prompts: DataFrame, client: Client, retries: int = 0, wait: float = 0.0, limits: Limits = Limits(), ledger: str | None = None) -> DataFrame:
    """prompts with what the client made of each row: output, call_status (ok, error), attempts, error, seconds.

    An exception is caught and tried again up to `retries` times; a row that fails stays, with a null output. With a
    ledger (a folder) no prompt that has a good reply there is asked again, see answered_once."""

    def ask(record: dict, begin: Callable[[], None]) -> dict:
        began, error, output, attempt = time.monotonic(), None, None, 0
        for attempt in range(1, retries + 2):
            try:
                begin()
                output, error = client(record), None
                break
            except Exception as e:  # noqa: BLE001  any failure of a client is a failed row
                error = f"{type(e).__name__}: {e}"
                if attempt <= retries:
                    time.sleep(wait)
        return {"output": output, "call_status": "ok" if error is None else "error", "attempts": attempt, "error": error, "seconds": time.monotonic() - began}

    if ledger:
        return answered_once(prompts, ask, CALL_SCHEMA, ledger, lambda reply: reply["call_status"] == "ok", limits)
    return answered(prompts, ask, CALL_SCHEMA, limits)


def batches(kb: DataFrame, size: int, key: str = "Record_ID", order: str = "row_id", text: str = "line") -> DataFrame:
    """(batch_id, batch_ids, batch_text): rows in their order, `size` a batch; row numbers come from a dense `order`."""
    number = F.floor((F.col(order) - 1) / size) + 1
    rows = kb.withColumn("batch_id", F.format_string("b%03d", number.cast("bigint")))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(key).cast("string").alias("k"), F.col(text).alias("t"))))
    return rows.groupBy("batch_id").agg(listed.alias("r")).select(
        "batch_id", F.transform("r", lambda s: s["k"]).alias("batch_ids"), F.array_join(F.transform("r", lambda s: s["t"]), "\n").alias("batch_text")
    )


def valid_ids(raw: Column, allowed: Column) -> Column:
    """Struct ids (those allowed, once, in their order) and dropped (all others, repeats included)."""
    kept = F.array_distinct(F.filter(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.array_contains(allowed, x)))
    return let(kept, lambda k: F.struct(k.alias("ids"), (F.size(F.coalesce(raw, F.array().cast("array<string>"))) - F.size(k)).alias("dropped")))


def _keys(df: DataFrame) -> list[str]:
    """What tells the questions of a run apart: q_id, and the model where several are asked."""
    return [c for c in ("model", "q_id") if c in df.columns]


def map_step(questions: DataFrame, parts: DataFrame, client: Client, retries: int = 2, **how) -> DataFrame:
    """A row a question (of each model, if there is a column model) and batch: the ids of the batch that the client
    names. A failed or unreadable reply counts as failed, without ids. how: limits and ledger of called()."""
    prompts = questions.crossJoin(parts).withColumn("stage", F.lit("map"))  # every question is asked of every batch
    out = called(prompts, client, retries, **how).withColumn("reply", F.from_json(json_body(F.col("output")), REPLY))
    ids = F.coalesce("reply.matched_row_ids", "reply.relevant_record_ids")
    ok = (F.col("call_status") == "ok") & ids.isNotNull()
    checked = valid_ids(ids, F.col("batch_ids"))
    return out.select(
        *_keys(out), "question", "batch_id", F.when(ok, checked["ids"]).otherwise(F.array().cast("array<string>")).alias("matched_ids"),
        F.when(ok, checked["dropped"]).otherwise(F.lit(0)).alias("dropped"), F.when(ok, "ok").otherwise("failed").alias("map_status"), "attempts", "error", "seconds",
    )


def union_step(mapped: DataFrame) -> DataFrame:
    """A row a question: ids of all batches, once, in natural order, and how the map step went."""
    return mapped.groupBy(*_keys(mapped), "question").agg(
        natural_sorted(F.array_distinct(F.flatten(F.collect_list("matched_ids")))).alias("candidate_ids"), F.count("*").alias("n_batches"),
        F.count_if(F.col("map_status") == "failed").alias("n_map_failed"), F.sum("dropped").alias("dropped"), F.sum("seconds").alias("map_seconds"),
    )


def verify_step(union: DataFrame, lines: DataFrame, client: Client, **how) -> DataFrame:
    """Keeps the candidates that the client confirms; a failure keeps all of them; without candidates it isn't asked."""
    none, keys = F.array().cast("array<string>"), _keys(union)
    texts = union.select(*keys, F.posexplode("candidate_ids").alias("at", "id")).join(lines.select(F.col("Record_ID").alias("id"), "line"), "id")
    bodies = texts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("candidate_text"))
    full = union.join(bodies, keys, "left")
    asked = called(full.filter(F.size("candidate_ids") > 0).withColumn("stage", F.lit("verify")), client, **how)
    reply = F.from_json(json_body(F.col("output")), REPLY)
    asked = asked.withColumn("reply", reply).withColumn("ok", (F.col("call_status") == "ok") & F.col("reply.verified_row_ids").isNotNull())
    kept, gone = valid_ids(F.col("reply.verified_row_ids"), F.col("candidate_ids")), valid_ids(F.col("reply.removed_row_ids"), F.col("candidate_ids"))
    names = [*union.columns]
    done = asked.select(
        *names, "candidate_text", F.when(F.col("ok"), kept["ids"]).otherwise(F.col("candidate_ids")).alias("verified_ids"), F.when(F.col("ok"), gone["ids"]).otherwise(none).alias("removed_ids"),
        F.when(F.col("ok"), "ok").otherwise("failed").alias("verify_status"), F.col("seconds").alias("verify_seconds"),
    )
    idle = full.filter(F.size("candidate_ids") == 0).select(*names, F.lit(None).cast("string").alias("candidate_text"), none.alias("verified_ids"), none.alias("removed_ids"), F.lit("ok").alias("verify_status"), F.lit(0.0).alias("verify_seconds"))
    return done.unionByName(idle)


def reduce_step(verified: DataFrame, client: Client, **how) -> DataFrame:
    """The answer from the verified rows; a failure is an empty answer."""
    out = called(verified.withColumn("stage", F.lit("reduce")), client, **how)
    status = F.when(F.col("call_status") == "ok", "ok").otherwise("failed")
    return out.select(*verified.columns, F.coalesce("output", F.lit("")).alias("reduce_answer"), status.alias("reduce_status"), F.col("seconds").alias("reduce_seconds"), F.col("error").alias("reduce_error"))


def _steps(questions: DataFrame, kb: DataFrame, client: Client, keep: Callable[[DataFrame, str], DataFrame], size: int, retries: int, **how) -> tuple[DataFrame, DataFrame]:
    mapped = keep(map_step(questions, batches(kb, size), client, retries, **how), "map")
    verified = keep(verify_step(union_step(mapped), kb.select("Record_ID", "line"), client, **how), "verify")
    return mapped, keep(reduce_step(verified, client, **how), "reduce")


def map_verify_reduce(questions: DataFrame, kb: DataFrame, client: Client, keep: Callable[[DataFrame, str], DataFrame], size: int = 40, retries: int = 2, **how) -> DataFrame:
    """The batched run. keep(df, name) writes a step's rows and reads them back, so that later steps don't ask anew;
    with a ledger (in how, as of called()) no prompt is asked twice, whichever task or run is run again."""
    return _steps(questions, kb, client, keep, size, retries, **how)[1].drop("reduce_error")


def batched_run(
    questions: DataFrame, kb: DataFrame, models: list[str], client: Client, keep: Callable[[DataFrame, str], DataFrame], size: int = 40, retries: int = 2, config: dict | None = None, **how
) -> DataFrame:
    """The batched run of several models, a record a model and question with the columns of stored batched answers
    (BATCH_SCHEMA): each batch's outcome, candidates, verification, answer, diagnostics, seconds and configuration.

    The client is given the model in each prompt record. questions: q_id, question; config: further values of the
    records' configuration. Written as JSON lines, the records are what batch_answers reads."""
    names = questions.sparkSession.createDataFrame([(m,) for m in models], "model string")
    mapped, rows = _steps(questions.select("q_id", "question").crossJoin(F.broadcast(names)), kb, client, keep, size, retries, **how)  # a few models
    part = F.struct(
        "batch_id", F.col("matched_ids").alias("relevant_record_ids"), F.col("matched_ids").alias("matched_row_ids"), "map_status", "attempts", F.col("dropped").cast("int").alias("dropped_hallucinated_count"), "error"
    )
    parts = mapped.groupBy("model", "q_id").agg(F.array_sort(F.collect_list(part)).alias("map"))
    picked = selection(rows.select(F.struct("model", "q_id").alias("q_id"), "verified_ids"), kb).select("q_id.*", "companies", "announced", "selection_rate")
    verified = F.struct("verify_status", F.col("verified_ids").alias("verified_row_ids"), F.col("removed_ids").alias("removed_row_ids"))
    told = F.struct(
        F.col("n_batches").cast("int").alias("n_batches"), F.col("n_map_failed").cast("int").alias("n_map_failed"), F.size("verified_ids").alias("union_size"),
        F.col("companies").cast("int").alias("union_distinct_companies"), F.col("announced").cast("int").alias("union_announced_count"), F.col("selection_rate").cast("double").alias("selection_rate"),
    )
    own = F.struct(F.lit(size).alias("batch_size"), *[F.lit(v).alias(k) for k, v in (config or {}).items()])
    return rows.join(parts, ["model", "q_id"]).join(picked, ["model", "q_id"]).select(
        "q_id", "question", "model", F.lit("batchwise_map_reduce").alias("arm"), "map", F.col("candidate_ids").alias("candidate_record_ids"), verified.alias("verification"),
        F.col("verified_ids").alias("union_record_ids"), F.col("verified_ids").alias("verified_record_ids"), "reduce_answer", "reduce_status", "reduce_error", told.alias("diagnostics"),
        F.struct("map_seconds", "verify_seconds", "reduce_seconds").alias("timing"), own.alias("config"),
    )


def selection(rows: DataFrame, kb: DataFrame, ids: str = "verified_ids") -> DataFrame:
    """(q_id, selected, companies, announced, selection_rate) of a run's rows; questions without ids have zeros."""
    total = kb.count()
    company = F.coalesce(F.nullif(F.trim(F.col("Company_Clean")), F.lit("")), F.col("Company")) if "Company_Clean" in kb.columns else F.col("Company")
    long = rows.select("q_id", F.explode(ids).alias("Record_ID")).join(kb.select("Record_ID", company.alias("c"), "Is_Announcement"), "Record_ID")
    made = long.groupBy("q_id").agg(F.count("*").alias("selected"), F.count_distinct(F.nullif(F.trim("c"), F.lit(""))).alias("companies"), F.count_if("Is_Announcement").alias("announced"))
    rate = F.bround(F.col("selected") / total, 4) if total else F.lit(0.0)
    return rows.select("q_id").join(made, "q_id", "left").na.fill(0, ["selected", "companies", "announced"]).withColumn("selection_rate", rate)


def direct_prompts(questions: DataFrame, kb_text: str, rules: str, models: list[str], gold: DataFrame | None = None) -> DataFrame:
    """A prompt a model and question: rules, the whole table, the question. With gold, a prompt that contains its
    question's gold answer is an error."""
    names = questions.sparkSession.createDataFrame([(m,) for m in models], "model_name string")
    prompt = F.concat_ws("\n\n", F.lit(rules), F.lit(kb_text), F.concat(F.lit("Question: "), F.col("question")))
    out = questions.crossJoin(F.broadcast(names)).withColumn("prompt", prompt)  # a few models
    if gold is not None:
        out = out.join(gold.select("question_number", "golden_answer"), "question_number", "left").withColumn("golden_answer", F.coalesce("golden_answer", F.lit("")))
        leak = F.raise_error(F.concat(F.lit("gold answer in the prompt of question "), F.col("question_number").cast("string"))).cast("string")
        out = out.withColumn("prompt", F.when((F.col("golden_answer") != "") & F.contains("prompt", "golden_answer"), leak).otherwise(F.col("prompt")))
    digest = lambda c: F.sha2(c, 256)
    return out.withColumns({"prompt_hash": digest(F.col("prompt")), "kb_hash": digest(F.lit(kb_text)), "question_hash": digest(F.col("question")), "approx_tokens": approx_tokens(F.col("prompt"))})


def run_status(completed: Column, errors: Column, total: Column) -> Column:
    return F.when(completed == 0, "failed").when((errors > 0) & (errors >= F.greatest(F.lit(1), F.floor(total / 3))), "runtime_unstable").when(errors > 0, "completed_with_errors").otherwise("completed")


def run_summary(answers: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """A row a model: answers completed and failed, prompt tokens, seconds, status of the run and of the context.

    answers: model_name, status, prompt_eval_count, runtime_seconds, num_ctx, approx_tokens. Models without an answer
    (of `models`) have failed."""
    ok = F.col("status") == "ok"
    tokens = F.when(ok, F.col("prompt_eval_count"))
    out = answers.groupBy("model_name").agg(
        F.count("*").alias("total_questions"), F.count_if(ok).alias("completed_answers"), F.count_if(F.col("status") == "error").alias("error_count"), F.min(tokens).alias("prompt_min"),
        F.median(tokens).alias("prompt_mid"), F.max(tokens).alias("prompt_max"), F.sum(F.when(ok, F.col("runtime_seconds"))).alias("total_seconds"), F.avg(F.when(ok, F.col("runtime_seconds"))).alias("average_seconds"),
        F.max("num_ctx").alias("num_ctx"), F.max("approx_tokens").alias("sent"),
    )
    capped = (F.col("prompt_min") == F.col("prompt_max")) & (F.col("prompt_max") < F.col("num_ctx")) & F.col("prompt_max").isin(*ROUND_CONTEXTS)
    context = F.when(F.col("prompt_mid").isNull(), "failed").when((F.col("sent") > 0) & (F.col("prompt_mid") < 0.85 * F.col("sent")), "truncated_context").when(capped, "truncated_context").otherwise("valid_full_context")
    out = out.withColumn("context_status", context).withColumn("run_status", run_status(F.col("completed_answers"), F.col("error_count"), F.col("total_questions")))
    out = out.withColumn("prompt_median", F.col("prompt_mid").cast("int")).drop("prompt_mid", "num_ctx", "sent")
    if models is not None:
        out = models.select("model_name").join(out, "model_name", "left").withColumn("run_status", F.coalesce("run_status", F.lit("failed"))).withColumn("context_status", F.coalesce("context_status", F.lit("failed")))
    return out


