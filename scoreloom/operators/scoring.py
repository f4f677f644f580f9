"""Scores of an answer against its gold record, as expressions over arrays; aggregates over answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_even, let, match_score, norm, numbers_said, plain_value


def set_scores(pred: Column, gold: Column) -> Column:
    """Struct precision, recall, f1 of two arrays as sets. Both empty: 1, 1, 1; only gold empty: 0, 1, 0; only pred
    empty: 0, 0, 0. A null array counts as an empty one."""
    p, g = (F.coalesce(F.array_distinct(a), F.array()) for a in (pred, gold))
    hits = F.size(F.array_intersect(p, g)).cast("double")
    none_p, none_g = F.size(p) == 0, F.size(g) == 0
    precision = F.when(none_p & none_g, 1.0).when(none_p | none_g, 0.0).otherwise(hits / F.size(p))
    recall = F.when(none_g, 1.0).when(none_p, 0.0).otherwise(hits / F.size(g))
    f1 = F.when(none_p & none_g, 1.0).when(hits == 0, 0.0).otherwise(2 * hits / (F.size(p) + F.size(g)))
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def differences(pred: Column, gold: Column) -> Column:
    """Struct missing, extra: sorted JSON arrays of what only one side has."""
    return F.struct(F.to_json(F.array_sort(F.array_except(gold, pred))).alias("missing"), F.to_json(F.array_sort(F.array_except(pred, gold))).alias("extra"))


def entity_basis(gold_companies: Column, gold_counties: Column, gold_count: Column) -> Column:
    return F.when(F.size(gold_companies) > 0, "company").when(F.size(gold_counties) > 0, "county").when(gold_count == 0, "none_expected").otherwise("not_applicable")


def count_scores(pred: Column, gold: Column) -> Column:
    """Struct error, correct; null unless both are known."""
    return F.struct((pred - gold).alias("count_error"), (pred == gold).alias("count_correct"))


def numeric_recall(pred: Column, gold: Column) -> Column:
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(pred, g)) / F.size(g))


def id_scores(cited: Column, pred_count: Column) -> Column:
    """Struct duplicate_ids, count_matches_ids (null without both)."""
    distinct = F.size(F.array_distinct(cited))
    return F.struct((F.size(cited) - distinct).alias("duplicate_ids"), F.when((F.size(cited) > 0) & pred_count.isNotNull(), pred_count == distinct).alias("count_matches_ids"))


def valid_and_bad(answers: DataFrame, keys: list[str], cited: str, kb: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(keys, valid_ids, bad_ids) of answers that cite any: ids that the knowledge table has and others, in the order
    of the answer, repeats kept. Cited ids meet the table's by a join, however many it has."""
    rows = answers.select(*keys, F.posexplode(cited).alias("at", "__id"))
    known = kb.select(F.col(row_id).alias("__id")).distinct().withColumn("__known", F.lit(True))
    met = rows.join(known, "__id", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "__id", F.coalesce("__known", F.lit(False)).alias("known")))).alias("ids"))
    part = lambda want: F.transform(F.filter("ids", lambda s: s["known"] == want), lambda s: s["__id"])
    return met.select(*keys, part(True).alias("valid_ids"), part(False).alias("bad_ids"))


def answered(status: Column, response: Column) -> Column:
    return F.coalesce((F.lower(status) == "ok") & (F.trim(F.coalesce(response, F.lit(""))) != ""), F.lit(False))


def field_checks(answers: DataFrame, keys: list[str], kb: DataFrame, fields: list[str], company: str = "Company", numeric: tuple[str, ...] = ("Employment",)) -> DataFrame:
    """A row for each answer, gold company and requested field that the knowledge table has a value of.

    answers: keys, response, gold_companies and requested_fields. The score is the best over the company's rows."""
    stack = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    long = kb.selectExpr(f"`{company}` as company", "row_id", f"stack({len(fields)}, {stack}) as (field, value)").filter("trim(value) <> ''")
    long = long.withColumns({"plain": plain_value(F.col("value")), "normed": norm(F.col("value"))})
    wanted = answers.select(*keys, F.explode("gold_companies").alias("company"), "requested_fields").select(*keys, "company", F.explode("requested_fields").alias("field"))
    # An answer's values are brought to it, not its text to every value: the text is normalised and carried once. A value
    # that many companies have is looked for once, and of the text's tokens and numbers only those that values have.
    due = wanted.join(long, ["company", "field"]).groupBy(*keys, F.col("field").isin(*numeric).alias("number") if numeric else F.lit(False).alias("number"), "plain", "normed")
    due = due.agg(F.collect_list(F.struct("company", "field", "row_id", "value")).alias("of")).groupBy(*keys).agg(F.collect_list(F.struct("plain", "normed", "number", "of")).alias("due"))
    said = answers.select(*keys, norm(F.col("response")).alias("said"), numbers_said(F.col("response")).alias("numbers")).join(due, keys)
    words = F.array_distinct(F.flatten(F.transform("due", lambda d: F.split(d["normed"], " "))))
    met = F.struct(F.array_intersect(F.split("said", " "), words).alias("tokens"), F.array_intersect("numbers", F.transform("due", lambda d: d["plain"])).alias("numbers"))
    score = lambda d, m: match_score(d["plain"], d["normed"], F.col("said"), m["numbers"], d["number"], m["tokens"])
    made = let(met, lambda m: F.transform("due", lambda d: F.struct(d["of"].alias("of"), score(d, m).alias("score"))))
    out = said.select(*keys, F.explode(made).alias("d")).select(*keys, "d.score", F.explode("d.of").alias("o")).select(*keys, "o.*", "score").groupBy(*keys, "company", "field")
    best = out.agg(F.max("score").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "value"))), lambda s: s["value"]), "; ").alias("expected_values"))
    return best.select(*keys, "company", "field", "expected_values", half_even(F.col("best"), 3).alias("field_value_score"), F.coalesce(F.col("best") >= 0.6, F.lit(False)).alias("field_value_present"))


def field_accuracy(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Share of an answer's checks with a rounded score of 0.6 or more; answers without checks have no row."""
    hit = (F.coalesce(F.col("field_value_score"), F.lit(0.0)) >= 0.6).cast("double")
    return checks.groupBy(*keys).agg(F.avg(hit).alias("field_value_accuracy"), F.count("*").alias("field_checks"))


def composite(f1: Column, count_rate: Column, field_accuracy: Column, hallucination_rate: Column, format_rate: Column, reliability: Column) -> Column:
    """0.45 F1, 0.20 count, 0.15 fields, 0.10 without hallucination, 0.05 format, 0.05 reliability; null parts are 0."""
    part = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.45 * part(f1) + 0.20 * part(count_rate) + 0.15 * part(field_accuracy) + 0.10 * (1 - hallucination_rate) + 0.05 * format_rate + 0.05 * reliability
