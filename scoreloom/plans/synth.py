"""Knowledge table, gold records and model answers made from the star schema, with defects that follow from the keys.

Every expected metric can be worked out from the keys alone, without parsing an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Models: name, arm, and every how many firms one is left out, misspelled, cited by a wrong row, and made up.
MODELS = (
    ("alpha", "direct_context", 5, 11, 13, 3),
    ("beta", "direct_context", 7, 9, 17, 4),
    ("gamma", "batchwise_map_reduce", 4, 13, 8, 2),
    ("delta", "batchwise_map_reduce", 9, 7, 11, 5),
)
KINDS = ("Motors", "Plastics", "Steel", "Systems", "Technologies")
FORMS = ("Inc", "LLC", "Corp")
TIERS = ("OEM", "Tier 1", "Tier 1/2", "Tier 2", "Tier 2/3", "Tier 3")
ROLES = ("Battery Cell", "Battery Pack", "Power Electronics", "Thermal Management", "Vehicle Assembly", "Materials", "General Automotive")
FACILITIES = ("Manufacturing Plant", "Headquarters", "Research Center", "Distribution Hub")


def _pick(values, c: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({c} % {len(values)} as int) + 1)"


def firm(key: str) -> str:
    return f"concat('Firm', lpad(cast({key} as string), 5, '0'), ' ', {_pick(KINDS, key)}, ' ', {_pick(FORMS, key)})"


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge table: suppliers as companies, nations as counties."""
    s, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "cast(s_suppkey + 1 as int) as row_id", f"{firm('s_suppkey')} as Company", f"{_pick(TIERS, 's_suppkey')} as Category",
        "concat('Industry ', cast(s_suppkey % 9 as string), ' Components') as `Industry Group`", "concat('Town ', cast(s_suppkey % 50 as string), ', ', n_name) as Location",
        "n_name as county", f"{_pick(FACILITIES, 's_suppkey')} as `Primary Facility Type`", f"{_pick(ROLES, 's_suppkey')} as `EV Supply Chain Role`",
        "if(s_suppkey % 6 = 0, 'Multiple OEMs', concat('Maker ', cast(s_suppkey % 5 as string))) as `Primary OEMs`",
        "if(s_acctbal < 0, null, floor(s_acctbal / 10)) as Employment", "concat('Product line ', cast(s_suppkey % 17 as string)) as `Product / Service`",
        f"{_pick(('Yes', 'Indirect', 'No'), 's_suppkey')} as `EV / Battery Relevant`", "s_suppkey", "s_nationkey",
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question a nation: which companies are there. Its other numbers are their row ids."""
    kb = knowledge(spark, sf_dir)
    return kb.groupBy(F.col("s_nationkey").alias("question_number"), "county").agg(F.array_sort(F.collect_set("Company")).alias("gold_companies"), F.collect_set(F.col("row_id").cast("string")).alias("numbers")).select(
        F.col("question_number").cast("int"), F.concat(F.lit("Which suppliers are in the county "), "county", F.lit(" and what is their tier?")).alias("question"),
        "gold_companies", F.array("county").alias("gold_counties"), F.size("gold_companies").alias("gold_count"), "county",
        F.array_remove("numbers", F.size("gold_companies").cast("string")).alias("gold_numbers"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sectioned answer for each question and model."""
    models = spark.createDataFrame([(i, *m) for i, m in enumerate(MODELS)], "m int, model_name string, arm string, drop int, spell int, swap int, fake int")
    rows = knowledge(spark, sf_dir).crossJoin(F.broadcast(models)).filter("(s_suppkey + m) % drop <> 0")  # four models
    company = F.expr("if((s_suppkey + m) % spell = 0, concat(substr(Company, 1, 9), 'x', substr(Company, 10)), Company)")
    cited = F.expr("if((s_suppkey + m) % swap = 0, row_id + 1, row_id)")
    made = rows.select("m", "model_name", "arm", "fake", F.col("s_nationkey").cast("int").alias("question_number"), "s_suppkey", company.alias("company"), cited.alias("cited"), "Category")
    grouped = made.groupBy("m", "model_name", "arm", "fake", "question_number").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "company", "cited", "Category"))).alias("rows"))
    every = gold(spark, sf_dir).select("question_number", "question").crossJoin(F.broadcast(models.select("m", "model_name", "arm", "fake")))
    full = every.join(grouped, ["m", "model_name", "arm", "fake", "question_number"], "left")
    rows_ = F.coalesce("rows", F.array().cast("array<struct<s_suppkey:bigint,company:string,cited:int,Category:string>>"))
    fake = F.expr("(question_number + m) % fake = 0")
    lines = F.transform(rows_, lambda r: F.concat(F.lit("| "), r["cited"].cast("string"), F.lit(" | "), r["company"], F.lit(" | "), r["Category"], F.lit(" |")))
    lines = F.when(fake, F.concat(lines, F.array(F.lit("| 9999 | Zyqwortex Brumvald Group | Tier 9 |")))).otherwise(lines)
    text = F.concat_ws(
        "\n", F.lit("Answer: The companies are listed below."), F.lit("Evidence:"), F.lit("| row_id | Company | Category |"), F.lit("|---|---|---|"), F.array_join(lines, "\n"),
        F.concat(F.lit("Count: "), F.size(lines).cast("string")), F.concat(F.lit("Supporting row_ids: "), F.array_join(F.transform(rows_, lambda r: r["cited"].cast("string")), ", ")),
        F.lit("Notes: none"),
    )
    failed = F.expr("(question_number * 7 + m) % 19 = 0")
    return full.select(
        "arm", "model_name", "question_number", "question", F.when(failed, "").otherwise(text).alias("response"), F.when(failed, "error").otherwise("ok").alias("status"),
        (F.lit(1000) + F.col("question_number") * 3 + F.col("m")).cast("int").alias("prompt_eval_count"), ((F.col("question_number") + 1) * 0.5 + F.col("m")).alias("runtime_seconds"),
    )
