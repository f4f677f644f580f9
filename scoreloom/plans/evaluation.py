"""Deterministic evaluation: a wide row of scores an answer, then summaries by model, question and arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import extract_count, extract_numbers, half_even, inline_thinking, judge_recommended, norm, question_type, requested_fields, section_flags, sorted_numbers, supporting_ids
from ..operators.entities import alias_table, companies_in, counties_in, lengths_of
from ..operators.gold import unknown_mentions
from ..operators.mentions import class_counts, classify, mentions, row_id_checks
from ..operators.scoring import answered, composite, count_scores, differences, entity_basis, field_accuracy, field_checks, id_scores, numeric_recall, set_scores, valid_and_bad
from ..sources.stored import stored

KEYS = ["arm", "model_name", "question_number"]
#: What tells answers apart: any of KEYS may be null or repeat.
ID = ["answer_id"]
# Fields whose values are checked.
FIELDS = ["Category", "Industry Group", "Location", "Primary Facility Type", "EV Supply Chain Role", "Primary OEMs", "Employment", "Product / Service", "EV / Battery Relevant"]
#: Columns that stored answers may have and that are carried along; missing ones are null.
CARRIED = {
    "status": "string", "error_message": "string", "prompt_eval_count": "int", "eval_count": "int", "num_ctx_requested": "int", "runtime_seconds": "double",
    "map_failed_count": "int", "candidate_count": "int", "verified_count": "int", "source_file": "string",
}
#: The counters of a mention's class, by the class.
COUNTERS = {
    "known_kb_company": "mention_known_kb_company_count", "misspelled_kb_company": "mention_misspelled_kb_company_count", "industry_group_false_positive": "mention_industry_group_fp_count",
    "product_service_false_positive": "mention_product_service_fp_count", "kb_supported_non_company_field": "mention_kb_noncompany_field_count",
    "not_a_company_phrase": "mention_not_a_company_phrase_count", "true_out_of_kb_hallucination": "mention_true_hallucination_count",
}


def with_answer_id(answers: DataFrame, keep=stored) -> DataFrame:
    """answers with answer_id, a number of its own for each row, written so that every branch reads the same."""
    return answers if "answer_id" in answers.columns else keep(answers.withColumn("answer_id", F.monotonically_increasing_id()))


def gold_of(gold: DataFrame, order: str = "gold_at") -> DataFrame:
    """Gold rows with all columns that scoring asks for; what gold_records has not made is made of the question. Of
    rows of one question number the last counts: by the column `order` if there is one, else as they are read."""
    q = F.col("question")
    made = {
        "question_type": question_type(q), "judge_recommended": judge_recommended(q), "requested_fields": requested_fields(q), "gold_numbers": F.array().cast("array<string>"),
        "use_case_category": F.lit(None).cast("string"),
    }
    full = gold.withColumns({c: v for c, v in made.items() if c not in gold.columns})
    names = ["question_type", "judge_recommended", "use_case_category", "requested_fields", "gold_companies", "gold_counties", "gold_count", "gold_numbers"]
    at = F.col(order) if order in gold.columns else F.monotonically_increasing_id()
    return full.select("question_number", F.struct(*names).alias("g"), at.alias("at")).groupBy("question_number").agg(F.max_by("g", "at").alias("g")).select("question_number", "g.*")


def scored_answers(answers: DataFrame, gold: DataFrame, kb: DataFrame, keep=stored) -> DataFrame:
    """A row an answer that has a gold record: its extracted parts, scores and counters. Equal answers, and answers
    without an arm or a model's name, keep a row each.

    keep: how the few tables that several branches read are stored (written to the shared folder, unless callers say
    otherwise). answers: KEYS, response and any of CARRIED. gold: question_number, question, gold_companies,
    gold_counties, gold_count and what else gold_records makes. Absent values are null; lists are JSON."""
    answers = answers.select(*[c for c in ["answer_id", *KEYS, "response", *CARRIED] if c in answers.columns])
    missing = {c: F.lit(None).cast(k) for c, k in CARRIED.items() if c not in answers.columns}
    base = with_answer_id(answers.withColumns(missing | {"response": F.coalesce("response", F.lit(""))}).join(gold_of(gold), "question_number"), keep)
    kb = keep(kb)
    aliases = keep(alias_table(kb))
    sizes = lengths_of(aliases)
    counties = kb.select(F.trim(F.regexp_extract("Location", r"(?s),(.*)$", 1)).alias("county")).filter("county <> ''").distinct().withColumn("alias", norm(F.col("county")))
    texts = base.select(*ID, "response")
    r = F.col("response")
    cited = base.select(*ID, supporting_ids(r).alias("cited"))
    found = base.join(companies_in(texts, ID, "response", aliases, sizes), ID).join(counties_in(texts, ID, "response", counties), ID).join(valid_and_bad(cited, ID, "cited", kb), ID, "left")
    parts = keep(found.withColumns({
        "answered": answered(F.col("status"), r), "pred_count": extract_count(r), "sections": section_flags(r), "cited": supporting_ids(r), "numbers": extract_numbers(r),
        "inline_thinking_leak": inline_thinking(r), "entity_basis": entity_basis(F.col("gold_companies"), F.col("gold_counties"), F.col("gold_count")),
        "company": set_scores(F.col("companies"), F.col("gold_companies")), "in_counties": set_scores(F.col("counties"), F.col("gold_counties")),
    }))
    none = F.array().cast("array<int>")
    by_basis = lambda p: F.when(F.col("entity_basis") == "county", F.col(f"in_counties.{p}")).when(F.col("entity_basis") != "not_applicable", F.col(f"company.{p}"))
    counted, ids, differ = count_scores(F.col("pred_count"), F.col("gold_count")), id_scores(F.col("cited"), F.col("pred_count")), differences(F.col("companies"), F.col("gold_companies"))
    flat = parts.select(
        *ID, *KEYS, "question_type", "judge_recommended", "use_case_category", "status", "answered", "error_message", "gold_count", "pred_count", counted["count_correct"].alias("count_correct"),
        counted["count_error"].alias("count_error"), F.size("gold_companies").alias("gold_company_count"), F.size("companies").alias("pred_company_count"),
        *[half_even(F.col(f"company.{p}"), 4).alias(f"company_{p}") for p in ("precision", "recall", "f1")], differ["missing"].alias("missing_companies"), differ["extra"].alias("extra_kb_companies"),
        F.size("gold_counties").alias("gold_county_count"), F.size("counties").alias("pred_county_count"), *[half_even(F.col(f"in_counties.{p}"), 4).alias(f"county_{p}") for p in ("precision", "recall", "f1")],
        "entity_basis", *[half_even(by_basis(p), 4).alias(f"entity_{p}") for p in ("precision", "recall", "f1")], F.to_json(sorted_numbers(F.col("gold_numbers"))).alias("gold_numbers"),
        half_even(numeric_recall(F.col("numbers"), F.col("gold_numbers")), 4).alias("numeric_recall"),
        *[F.col(f"sections.has_{s}").alias(f"has_{s}_section") for s in ("answer", "evidence", "count", "supporting_row_ids", "notes")], F.col("sections.format_core_ok").alias("format_core_ok"),
        F.to_json("cited").alias("supporting_row_ids"), F.size(F.array_distinct("cited")).alias("supporting_row_id_count"), F.to_json(F.coalesce("bad_ids", none)).alias("bad_supporting_row_ids"),
        F.size(F.coalesce("valid_ids", none)).alias("valid_supporting_row_id_count"), ids["duplicate_ids"].alias("duplicate_supporting_row_id_count"), ids["count_matches_ids"].alias("count_vs_supporting_ids_ok"),
        "inline_thinking_leak", "prompt_eval_count", "eval_count", "num_ctx_requested", "runtime_seconds", "map_failed_count", "candidate_count", "verified_count",
        F.length(r).alias("response_char_count"), "source_file",
    )
    checks = field_accuracy(field_checks(parts, ID, kb, [f for f in FIELDS if f in kb.columns]), ID).select(*ID, half_even(F.col("field_value_accuracy"), 4).alias("field_value_accuracy"))
    classes = class_counts(classify(mentions(texts, ID), ID, kb, aliases, keep, lengths=sizes), texts, ID)
    classes = classes.withColumnsRenamed({f"n_{c}": n for c, n in COUNTERS.items()})
    status = F.col("status")
    rows = row_id_checks(texts, ID, kb, aliases, keep=keep, lengths=sizes).groupBy(*ID).agg(
        F.count("*").alias("row_id_company_checked"), F.count_if(status == "mismatch").alias("row_id_company_mismatch_count"), F.count_if(status == "bad_row_id").alias("row_id_bad_count")
    )
    unknown = unknown_mentions(texts, ID, aliases, lengths=sizes).groupBy(*ID).agg(F.array_sort(F.collect_set("mention")).alias("m"))
    legacy = unknown.select(*ID, F.to_json("m").alias("legacy_unknown_company_mentions"), F.size("m").alias("legacy_unknown_company_mention_count"))
    out = flat.join(checks, ID, "left").join(classes, ID).join(rows, ID, "left").join(legacy, ID, "left")
    zeros = ["row_id_company_checked", "row_id_company_mismatch_count", "row_id_bad_count", "legacy_unknown_company_mention_count"]
    fp = F.col("mention_industry_group_fp_count") + F.col("mention_product_service_fp_count") + F.col("mention_kb_noncompany_field_count")
    return out.na.fill(0, zeros).na.fill("[]", ["legacy_unknown_company_mentions"]).withColumn("kb_supported_non_company_fp_count", fp)


def model_summary(scores: DataFrame) -> DataFrame:
    """A row an arm and model (null keys are groups too), with composite, and rank by the rounded composite."""
    rate = lambda c: F.avg((F.col(c) > 0).cast("double"))
    flag = lambda c: F.avg(F.col(c).cast("double"))
    made_up, misspelled, fp, mismatch = "mention_true_hallucination_count", "mention_misspelled_kb_company_count", "kb_supported_non_company_fp_count", "row_id_company_mismatch_count"
    judged, other = F.col("judge_recommended"), ~F.col("judge_recommended")
    grouped = scores.groupBy("arm", "model_name").agg(
        F.count("*").alias("questions"), F.count_if("answered").alias("answered"), (F.count_if("answered") / F.count("*")).alias("reliability"),
        F.avg("entity_f1").alias("mean_entity_f1"), F.avg("entity_precision").alias("mean_entity_precision"), F.avg("entity_recall").alias("mean_entity_recall"),
        F.avg(F.when(judged, F.col("entity_f1"))).alias("judge_entity_f1"), F.avg(F.when(other, F.col("entity_f1"))).alias("nonjudge_entity_f1"),
        F.count("count_correct").alias("count_questions_scored"), flag("count_correct").alias("count_accuracy_rate"), F.avg(F.when(F.col("count_correct").isNotNull(), F.abs("count_error"))).alias("mean_abs_count_error"),
        F.avg("numeric_recall").alias("mean_numeric_recall"), F.avg("field_value_accuracy").alias("field_value_accuracy"), flag("format_core_ok").alias("format_core_ok_rate"),
        rate(made_up).alias("true_hallucination_rate"), F.avg(made_up).alias("avg_true_hallucinations"), rate(misspelled).alias("misspelled_rate"), F.avg(misspelled).alias("avg_misspelled"),
        rate(fp).alias("non_company_fp_rate"), F.avg(fp).alias("avg_non_company_fp"), rate("legacy_unknown_company_mention_count").alias("legacy_unknown_rate"),
        rate(mismatch).alias("row_id_mismatch_rate"), F.avg(mismatch).alias("avg_row_id_mismatch"), F.sum("row_id_company_checked").alias("total_row_ids_checked"), F.sum(mismatch).alias("total_row_id_mismatches"),
        F.count_if("inline_thinking_leak").alias("inline_thinking_leaks"), F.avg("runtime_seconds").alias("avg_runtime_seconds"), F.sum("runtime_seconds").alias("total_runtime_seconds"),
        F.min("prompt_eval_count").alias("prompt_eval_min"), F.median("prompt_eval_count").alias("prompt_eval_median"), F.max("prompt_eval_count").alias("prompt_eval_max"),
    )
    c = F.col
    score = composite(c("mean_entity_f1"), c("count_accuracy_rate"), c("field_value_accuracy"), c("true_hallucination_rate"), c("format_core_ok_rate"), c("reliability"))
    legacy = composite(c("mean_entity_f1"), c("count_accuracy_rate"), c("field_value_accuracy"), c("legacy_unknown_rate"), c("format_core_ok_rate"), c("reliability"))
    rounded = {n: half_even(F.col(n), 4) for n, k in grouped.dtypes if k == "double"}
    return ranked(grouped.withColumns({"research_score": half_even(score, 4), "research_score_legacy": half_even(legacy, 4)}).withColumns(rounded), "research_score")


def split_means(scores: DataFrame, keys: list[str], value: str, flag: str) -> DataFrame:
    """Rows, and the mean of value over flagged and over other rows, in one pass."""
    return scores.groupBy(*keys).agg(F.count("*").alias("answers"), F.avg(F.when(F.col(flag), F.col(value))).alias("mean_flagged"), F.avg(F.when(~F.col(flag), F.col(value))).alias("mean_other"))


def ranked(df: DataFrame, score: str, name: str = "rank_by_research_score") -> DataFrame:
    """Rank from 1 of the highest score; equal scores share the lowest rank. For summaries: a row a model."""
    return df.withColumn(name, F.rank().over(W.orderBy(F.desc_nulls_last(score))))


def question_summary(scores: DataFrame) -> DataFrame:
    """A row a question: mean F1, count matches and the best answer (F1, then count; an unknown count before a right
    one, a right before a wrong one; then arm and model)."""
    known = F.when(F.col("count_correct").isNull(), 2).when(F.col("count_correct"), 1).otherwise(0)
    order = F.struct(F.coalesce("entity_f1", F.lit(-1.0)).alias("f"), known.alias("k"))
    first = F.min_by(F.concat_ws("::", "arm", "model_name"), F.struct((-order["f"]).alias("a"), (-order["k"]).alias("b"), F.col("arm").alias("c"), F.col("model_name").alias("d")))
    return scores.groupBy("question_number").agg(
        half_even(F.avg("entity_f1"), 4).alias("mean_entity_f1"), F.count_if("count_correct").alias("models_with_count_match"), F.count("count_correct").alias("models_scored_for_count"),
        F.first("gold_count").alias("gold_count"), first.alias("best_model_by_entity_f1"),
    )


def arm_summary(models: DataFrame) -> DataFrame:
    return models.groupBy("arm").agg(F.avg("research_score").alias("mean_research_score"), F.count("*").alias("models"))


#: The grains of grain_summary: what each groups scored answers by.
GRAINS = {"model": ["arm", "model_name"], "question": ["question_number"], "arm": ["arm"], "judged": ["judge_recommended"], "all": []}


def grain_summary(scores: DataFrame, grains: dict[str, list[str]] = GRAINS) -> DataFrame:
    """The same figures at every grain, in one pass over the scored answers: a row a grain and group, with the grain's
    name and the columns that it groups by (null where it doesn't, and where they are null themselves).

    Grouping sets make partial states of all grains in one scan, which meet in one exchange; medians are states too."""
    names = list(dict.fromkeys(c for cs in grains.values() for c in cs))
    flag = lambda c: F.avg(F.col(c).cast("double"))
    out = scores.groupingSets([[F.col(c) for c in cs] for cs in grains.values()], *[F.col(c) for c in names]).agg(
        F.grouping_id().alias("__grain"), F.count("*").alias("answers"), F.count_if("answered").alias("answered"), (F.count_if("answered") / F.count("*")).alias("reliability"),
        F.avg("entity_f1").alias("mean_entity_f1"), F.count("count_correct").alias("count_questions_scored"), flag("count_correct").alias("count_accuracy_rate"),
        F.avg("field_value_accuracy").alias("field_value_accuracy"), flag("format_core_ok").alias("format_core_ok_rate"), F.min("prompt_eval_count").alias("prompt_eval_min"),
        F.median("prompt_eval_count").alias("prompt_eval_median"), F.max("prompt_eval_count").alias("prompt_eval_max"), F.sum("runtime_seconds").alias("total_runtime_seconds"),
    )
    # The number of a grouping set has a bit for each column that it leaves out, the first column's the highest.
    numbers = {sum(1 << (len(names) - 1 - k) for k, c in enumerate(names) if c not in cs): grain for grain, cs in grains.items()}
    grain = F.coalesce(*[F.when(F.col("__grain") == n, g) for n, g in numbers.items()])
    return out.select(grain.alias("grain"), *names, *[c for c in out.columns if c not in names and c != "__grain"])


def model_summary_v1(scores: DataFrame) -> DataFrame:
    """The first version's summary, a row an arm and model (null keys are groups too): its columns, its score (company-like
    phrases that no alias has count as made up), and the rank by it."""
    c = F.col
    mean, flag = F.avg, lambda name: F.avg(c(name).cast("double"))
    unknown = c("legacy_unknown_company_mention_count")
    # The table's columns.
    grouped = scores.groupBy("arm", "model_name").agg(
        F.count("*").alias("questions"), F.count_if("answered").alias("answered"), (F.count_if("answered") / F.count("*")).alias("reliability"), mean("entity_f1").alias("mean_entity_f1"),
        mean("entity_precision").alias("mean_entity_precision"), mean("entity_recall").alias("mean_entity_recall"), mean(F.when(~c("judge_recommended"), c("entity_f1"))).alias("nonjudge_mean_entity_f1"),
        mean(F.when(c("judge_recommended"), c("entity_f1"))).alias("judge_recommended_mean_entity_f1"), F.count("count_correct").alias("count_questions_scored"), flag("count_correct").alias("count_accuracy_rate"),
        mean(F.when(c("count_correct").isNotNull(), F.abs("count_error"))).alias("mean_abs_count_error"), mean("field_value_accuracy").alias("field_value_accuracy"), flag("format_core_ok").alias("format_core_ok_rate"),
        mean((unknown > 0).cast("double")).alias("answers_with_unknown_company_mentions_rate"), mean(unknown).alias("avg_unknown_company_mentions"), F.count_if("inline_thinking_leak").alias("inline_thinking_leak_count"),
        mean("runtime_seconds").alias("avg_runtime_seconds"), F.sum("runtime_seconds").alias("total_runtime_seconds"), F.min("prompt_eval_count").alias("prompt_eval_min"), F.median("prompt_eval_count").alias("prompt_eval_median"),
        F.max("prompt_eval_count").alias("prompt_eval_max"),
    )
    score = composite(c("mean_entity_f1"), c("count_accuracy_rate"), c("field_value_accuracy"), c("answers_with_unknown_company_mentions_rate"), c("format_core_ok_rate"), c("reliability"))
    rounded = {n: half_even(c(n), 4) for n, k in grouped.dtypes if k == "double" and not n.startswith("prompt_")}
    made = grouped.withColumn("research_score_deterministic", half_even(score, 4)).withColumns(rounded)
    return ranked(made, "research_score_deterministic").orderBy("rank_by_research_score", "arm", "model_name")


def question_summary_v1(scores: DataFrame) -> DataFrame:
    """The first version's row a question: what all its answers share, and those of question_summary."""
    shared = ["question_type", "judge_recommended", "gold_company_count"]
    first = scores.groupBy("question_number").agg(*[F.first(c, ignorenulls=True).alias(c) for c in shared])
    return first.join(question_summary(scores), "question_number").select(
        "question_number", "question_type", "judge_recommended", "gold_count", "gold_company_count", "mean_entity_f1", "models_with_count_match", "models_scored_for_count", "best_model_by_entity_f1"
    )
