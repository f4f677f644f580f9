"""Stored answers of both arms as one table, resume state, and the sinks."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import capped_cell, ns_to_seconds

KEYS = ("arm", "model_name", "question_number")
ANSWER_SCHEMA = (
    "arm string, source_file string, model_name string, question_number int, question string, response string, status string, error_message string, "
    "prompt_eval_count int, eval_count int, num_ctx_requested int, runtime_seconds double, map_failed_count int, candidate_count int, verified_count int"
)
DIRECT_SCHEMA = (
    "question_number int, question string, golden_answer string, model_name string, model string, model_response string, status string, error_message string, "
    "num_ctx_requested int, actual_context_observed_if_available int, prompt_eval_count int, eval_count int, total_duration bigint, load_duration bigint, "
    "prompt_eval_duration bigint, eval_duration bigint, created_at string, prompt_hash string, kb_hash string, question_hash string, response_char_count int, "
    "notes string, native_thinking string"
)
BATCH_SCHEMA = (
    "q_id string, question string, model string, arm string, "
    "map array<struct<batch_id:string,relevant_record_ids:array<string>,matched_row_ids:array<string>,filter_interpretation:string,map_status:string,attempts:int,"
    "dropped_hallucinated_count:int,prompt_eval_count:int,eval_count:int,error:string,raw_response_preview:string>>, "
    "candidate_record_ids array<string>, "
    "verification struct<verify_status:string,verified_row_ids:array<string>,removed_row_ids:array<string>,verification_notes:string,"
    "dropped_hallucinated_verified_count:int,dropped_hallucinated_removed_count:int,prompt_eval_count:int,eval_count:int>, "
    "union_record_ids array<string>, verified_record_ids array<string>, reduce_answer string, reduce_status string, reduce_error string, "
    "diagnostics struct<n_batches:int,n_map_failed:int,union_size:int,union_distinct_companies:int,union_announced_count:int,selection_rate:double>, "
    "timing struct<map_seconds:double,verify_seconds:double,reduce_seconds:double>, "
    "config struct<batch_size:int,overlap:int,map_num_ctx:int,reduce_num_ctx:int,temperature:double,sort_key:string>, "
    "ollama struct<reduce_prompt_eval_count:int,reduce_eval_count:int,verify_prompt_eval_count:int,verify_eval_count:int>"
)


def _or(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def direct_answers(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(DIRECT_SCHEMA).json(path).withColumn("source_file", F.col("_metadata.file_path"))
    return rows.select(
        F.lit("direct_context").alias("arm"), "source_file", _or(F.col("model_name"), F.col("model")).alias("model_name"), "question_number", "question",
        F.coalesce("model_response", F.lit("")).alias("response"), "status", "error_message", "prompt_eval_count", "eval_count", "num_ctx_requested",
        ns_to_seconds(F.col("total_duration")).alias("runtime_seconds"), *[F.lit(None).cast("int").alias(c) for c in ("map_failed_count", "candidate_count", "verified_count")],
    )


def batch_answers(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(BATCH_SCHEMA).json(path).withColumn("source_file", F.col("_metadata.file_path"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    verified = F.col("verification.verified_row_ids")
    return rows.select(
        F.lit("batchwise_map_reduce").alias("arm"), "source_file", F.col("model").alias("model_name"), F.col("q_id").try_cast("int").alias("question_number"), "question",
        F.coalesce("reduce_answer", F.lit("")).alias("response"), F.col("reduce_status").alias("status"), F.col("reduce_error").alias("error_message"),
        F.col("ollama.reduce_prompt_eval_count").alias("prompt_eval_count"), F.col("ollama.reduce_eval_count").alias("eval_count"),
        F.col("config.reduce_num_ctx").alias("num_ctx_requested"),
        (zero("timing.map_seconds") + zero("timing.verify_seconds") + zero("timing.reduce_seconds")).alias("runtime_seconds"),
        F.col("diagnostics.n_map_failed").alias("map_failed_count"), F.size(F.coalesce("candidate_record_ids", F.array().cast("array<string>"))).alias("candidate_count"),
        F.size(F.coalesce(F.when(F.size(verified) > 0, verified), F.col("verified_record_ids"), F.array().cast("array<string>"))).alias("verified_count"),
    )


def both_arms(direct: DataFrame | None, batch: DataFrame | None) -> DataFrame:
    parts = [p for p in (direct, batch) if p is not None]
    if not parts:
        raise ValueError("no arm chosen")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def narrowed(answers: DataFrame, models: list[str] | None = None, questions: list[int] | None = None, first: int | None = None) -> DataFrame:
    """Answers of the models and questions named; first: of the first questions present, if none is named."""
    if models:
        answers = answers.filter(F.col("model_name").isin(models))
    if questions:
        return answers.filter(F.col("question_number").isin(questions))
    if first:
        numbers = answers.select("question_number").distinct().orderBy("question_number").limit(first)
        return answers.join(numbers, "question_number", "left_semi")
    return answers


def done_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of answers judged before. A key that is written as null is a key; lines that are no JSON or lack one are
    left out."""
    fields = F.from_json("value", "map<string,string>")
    rows = spark.read.text(path).select(fields.alias("m")).filter(" AND ".join(f"map_contains_key(m, '{k}')" for k in KEYS))
    return rows.select(*[F.col("m")[k].alias(k) for k in KEYS[:2]], F.col("m")["question_number"].try_cast("int").alias("question_number")).distinct()


def still_to_do(answers: DataFrame, done: DataFrame) -> DataFrame:
    """Answers whose key isn't among those done; a null in a key equals a null."""
    same = None
    for k in KEYS:
        one = answers[k].eqNullSafe(done[k])
        same = one if same is None else same & one
    return answers.join(done, same, "left_anti")


def judged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All judge records; a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """One folder a table, as the sheets of a workbook: CSV with a header (null as blank; quotes inside a cell written
    twice), Parquet or JSON."""
    for name, df in tables.items():
        if fmt == "csv":
            flat = {c: F.to_json(F.col(f"`{c}`")) for c, k in df.dtypes if k.startswith(("array", "struct", "map"))}
            capped = {c: capped_cell(F.col(f"`{c}`")) for c, k in df.dtypes if k == "string"}
            df = df.withColumns(flat | capped)
        df.write.mode(mode).options(header=True, nullValue="", emptyValue="", quote='"', escape='"').format(fmt).save(f"{folder}/{name}")


def append_json(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; nulls are written, so that a key that is null can be told from none."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """A small JSON document, through Spark's writer so that any store will do."""
    text = json.dumps(config, indent=2, sort_keys=True, default=lambda x: str(PurePosixPath(x)))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def present_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns named that are there, in the order named."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def fixed_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns named, in this order; others are left out and missing ones are null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
