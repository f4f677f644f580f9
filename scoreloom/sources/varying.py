"""Logs whose shape changes from version to version: each line as a VARIANT, known paths as columns, and all it holds
kept and written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .answers import ANSWER_SCHEMA

#: Where a field of an answer may stand in a line of either arm's log, first found first; blanks count as none.
PATHS = {
    "model_name": ("$.model_name", "$.model"), "question_number": ("$.question_number", "$.q_id"), "question": ("$.question",), "response": ("$.model_response", "$.reduce_answer", "$.response"),
    "status": ("$.status", "$.reduce_status"), "error_message": ("$.error_message", "$.reduce_error"), "prompt_eval_count": ("$.prompt_eval_count", "$.ollama.reduce_prompt_eval_count"),
    "eval_count": ("$.eval_count", "$.ollama.reduce_eval_count"), "num_ctx_requested": ("$.num_ctx_requested", "$.config.reduce_num_ctx"), "map_failed_count": ("$.diagnostics.n_map_failed",),
}
_KINDS = dict(c.split() for c in ANSWER_SCHEMA.split(", "))


def varying_log(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(line, record): each line of JSON-lines files, and its VARIANT. A line that is no JSON has a null record; strict:
    it is an error instead."""
    parse = F.parse_json if strict else F.try_parse_json
    return spark.read.text(path).filter("trim(value) <> ''").select(F.col("value").alias("line"), parse("value").alias("record"))


def field(record: Column | str, paths: tuple[str, ...], kind: str) -> Column:
    """The first of these paths that is there, can be a `kind` and, as text, isn't blank."""
    found = [F.try_variant_get(record, p, kind) for p in paths]
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in found]) if kind == "string" and len(paths) > 1 else F.coalesce(*found)


def varying_answers(log: DataFrame, paths: dict[str, tuple[str, ...]] = PATHS) -> DataFrame:
    """Answers of a log of either arm and any version: arm, the fields of `paths`, and record with all there was.

    Fields that a version lacks, or has in another type, are null. Lines that are no records are left out."""
    rows = log.filter(F.col("record").isNotNull() & F.startswith(F.schema_of_variant("record"), F.lit("OBJECT")))
    batched = F.try_variant_get("record", "$.reduce_answer", "string").isNotNull() | F.try_variant_get("record", "$.map", "variant").isNotNull()
    arm = F.coalesce(F.try_variant_get("record", "$.arm", "string"), F.when(batched, "batchwise_map_reduce").otherwise("direct_context"))
    return rows.select(arm.alias("arm"), *[field("record", p, _KINDS.get(c, "string")).alias(c) for c, p in paths.items()], "record")


def shapes(log: DataFrame) -> DataFrame:
    """(shape, records): how many records of the log have which fields and types."""
    return log.filter("record IS NOT NULL").groupBy(F.schema_of_variant("record").alias("shape")).agg(F.count("*").alias("records"))


def write_varying(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes rows as JSON lines: their record as it came, with the other columns put in where they aren't null. A field
    that no column knows is written as it was read."""
    others = [c for c in rows.columns if c != "record"]
    old = F.from_json(F.coalesce(F.to_json("record"), F.lit("{}")), "map<string, variant>")
    new = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.to_variant_object(F.struct(F.col(f"`{c}`").alias("v"))).alias("value"), F.col(f"`{c}`").isNotNull().alias("there")) for c in others]), lambda e: e["there"])
    # Objects of one field each: its value is taken out again, so that every column may have a type of its own.
    put = F.map_from_entries(F.transform(new, lambda e: F.struct(e["key"].alias("key"), F.variant_get(e["value"], "$.v", "variant").alias("value"))))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(put), k)) if others else old
    merged = F.map_concat(kept, put) if others else old
    rows.select(F.to_json(merged).alias("value")).write.mode(mode).text(path)
