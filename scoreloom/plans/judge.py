"""Rubric judging: the context of each answer, resumable scoring by a judge that callers give, and the ranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored
from .calls import Limits, answered, answered_once

# The rubric's metrics and the columns that a judge sees.
METRICS = ("factual_faithfulness", "completeness", "correctness", "evidence_grounding", "company_grounding", "usefulness")
REASON_LENGTH = 600


@dataclass(frozen=True)
class Rubric:
    """What a metric asks of a judge: its steps, and the fields of a case that it is shown (empty: all of them)."""

    steps: tuple[str, ...]
    sees: tuple[str, ...] = ()


# What a judge's context shows of a row.
CONTEXT_FIELDS = ("row_id", "Company", "Category", "Industry Group", "Location", "Primary Facility Type", "EV Supply Chain Role", "Primary OEMs", "Supplier or Affiliation Type", "Employment", "Product / Service", "EV / Battery Relevant")


def contexts(answers: DataFrame, keys: list[str], kb: DataFrame, max_rows: int = 45, keep=stored) -> DataFrame:
    """(keys, context, context_rows, context_basis, context_truncated), a row an answer.

    Rows that it cites and that exist, then rows of its gold companies; once each, in the order of row ids, at most
    max_rows. answers: keys, cited (array of row ids), gold_companies. Keys may repeat or be null: answers are told
    apart by a number of their own, written with them by keep."""
    out_keys, keys = keys, ["__answer"]
    answers = keep(answers.select(*out_keys, "cited", "gold_companies").withColumn("__answer", F.monotonically_increasing_id()))
    rows = kb.select("row_id", "Company", F.to_json(F.struct(*[c for c in CONTEXT_FIELDS if c in kb.columns])).alias("line"))
    cited = answers.select(*keys, F.explode("cited").alias("row_id")).join(rows.select("row_id"), "row_id").select(*keys, "row_id", F.lit(True).alias("by_cite"))
    owned = answers.select(*keys, F.explode("gold_companies").alias("Company")).join(rows.select("row_id", "Company"), "Company").select(*keys, "row_id", F.lit(False).alias("by_cite"))
    ids = cited.unionByName(owned).groupBy(*keys, "row_id").agg(F.max("by_cite").alias("by_cite"))
    numbered = ids.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("row_id")))
    size = ids.groupBy(*keys).agg(F.count("*").alias("all_rows"), F.max("by_cite").alias("any_cited"))
    lines = numbered.filter(F.col("n") <= max_rows).join(rows.select("row_id", "line"), "row_id").groupBy(*keys)
    made = lines.agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "line"))), lambda s: s["line"]).alias("context"))
    out = answers.select(*out_keys, *keys).join(size, keys, "left").join(made, keys, "left")
    basis = F.when(F.col("all_rows").isNull(), "none").when(F.col("any_cited"), "supporting+gold").otherwise("gold_companies")
    return out.select(
        *out_keys, F.coalesce("context", F.array().cast("array<string>")).alias("context"), F.least(F.coalesce("all_rows", F.lit(0)), F.lit(max_rows)).alias("context_rows"),
        basis.alias("context_basis"), (F.coalesce("all_rows", F.lit(0)) > max_rows).alias("context_truncated"),
    )


def judged(cases: DataFrame, judge: Callable[[str, dict], tuple[float, str]], metrics: tuple[str, ...] | dict[str, Rubric] = METRICS, limits: Limits = Limits(), ledger: str | None = None) -> DataFrame:
    """cases with a score and a reason of each metric, their mean over those that worked, and status.

    judge(metric, case) gives a score and a reason; where it raises, the score is null and status partial_error. An
    empty answer is judged as "(empty answer)"; reasons are cut to REASON_LENGTH characters. With a Rubric for each
    metric, a case has its steps as `steps`, and of its fields only those that the rubric shows: a metric that isn't to
    see the gold answer can't.

    limits and ledger: as of called(); a case that failed in part isn't taken from the ledger."""
    rubrics = metrics if isinstance(metrics, dict) else {}
    if unknown := {f for r in rubrics.values() for f in r.sees}.difference(cases.columns):
        raise ValueError(f"rubrics show fields that cases don't have: {sorted(unknown)}")
    metrics = tuple(metrics)

    def shown(metric: str, case: dict) -> dict:
        rubric = rubrics.get(metric)
        return case if rubric is None else {k: v for k, v in case.items() if not rubric.sees or k in rubric.sees} | {"steps": list(rubric.steps)}

    def ask(case: dict, begin: Callable[[], None]) -> dict:
        case["response"] = case.get("response") or "(empty answer)"
        out: dict = {"status": "ok"}
        for m in metrics:
            try:
                begin()
                score, reason = judge(m, shown(m, case))
                out[m], out[f"{m}_reason"] = float(score), str(reason)[:REASON_LENGTH]
            except Exception as e:  # noqa: BLE001  one metric's failure leaves the others
                out |= {m: None, f"{m}_reason": f"{type(e).__name__}: {e}"[:REASON_LENGTH], "status": "partial_error"}
        return out

    made = ", ".join([*[f"`{m}` double" for m in metrics], *[f"`{m}_reason` string" for m in metrics], "status string"])
    out = answered_once(cases, ask, made, ledger, lambda reply: reply["status"] == "ok", limits) if ledger else answered(cases, ask, made, limits)
    return out.withColumn("judge_mean", mean_of(list(metrics)))


def mean_of(columns: list[str]):
    """Mean of the columns that aren't null; null if all are."""
    known = F.lit(0)
    total = F.lit(0.0)
    for c in columns:
        known = known + F.col(c).isNotNull().cast("int")
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return F.when(known > 0, total / known)


def judge_summary(rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means by arm and model, and positions by the mean of means (equal ones by arm and model)."""
    out = rows.groupBy("arm", "model_name").agg(
        F.count("*").alias("answers_judged"), *[F.avg(m).alias(f"mean_{m}") for m in metrics], F.avg("judge_mean").alias("mean_judge"), F.count_if(F.col("status") == "partial_error").alias("partial_error_answers")
    )
    return out.withColumn("rank_by_judge", F.row_number().over(W.orderBy(F.desc_nulls_last("mean_judge"), "arm", "model_name")))
