"""What a gold answer's text says, and company-like phrases that no alias explains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import COMPANY_PHRASE, extract_count, extract_numbers, judge_recommended, norm, norm_company, question_type, requested_fields, sorted_numbers
from .entities import companies_in, counties_in

# Lines of gold answers that name no answer, and labels that are no company.
SKIPPED_STARTS = ("there are", "there is", "top ")
SKIPPED_LINES = ("oem footprint", "oem supply chain")
SKIPPED_PARTS = ("appears in both categories", "counted once")
LABELS = (
    "answer", "evidence", "count", "supporting row ids", "notes", "industry group", "category", "primary oems", "primary facility type", "ev supply chain role", "product service",
)
#: Length of the character runs by which mentions meet aliases: no mention looked for is shorter.
RUN = 4


def answer_part(line):
    """The part of a gold answer's line that names the answer: after "only company", before a bar, after a county's
    colon, else all of it; without bracketed remarks. Null for lines that name none."""
    low = norm(line)
    skipped = low.isin(*SKIPPED_LINES) | (low == "")
    for s in SKIPPED_STARTS:
        skipped = skipped | low.startswith(s)
    for s in SKIPPED_PARTS:
        skipped = skipped | low.contains(s)
    after_arrow = F.regexp_replace(F.regexp_extract(line, r"(?s)→(.*)$", 1), r"(?i)only company\s*:?", "")
    part = (
        F.when(line.rlike(r"(?i)only company\s*:"), F.regexp_extract(line, r"(?is)only company\s*:(.*)$", 1))
        .when(line.contains("→") & line.rlike("(?i)only company"), after_arrow)
        .when(line.contains("|"), F.regexp_extract(line, r"(?s)^([^|]*)\|", 1))
        .when(line.contains(":") & low.contains("county"), F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))
        .otherwise(line)
    )
    return F.when(~skipped, F.trim(F.regexp_replace(part, r"\[[^\]]+\]", "")))


def gold_companies(gold: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """(key, gold_companies) of every row: companies of its lines' answer parts, or of the whole text if none is there."""
    lines = gold.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\R")).alias("at", "line"))
    parts = lines.select(key, "at", answer_part(F.regexp_replace(F.trim("line"), r"^[\-*•\s]+", "")).alias("part"))
    by_line = companies_in(parts, [key, "at"], "part", aliases).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("companies")))).alias("by_line"))
    whole = companies_in(gold.select(key, text), [key], text, aliases)
    chosen = F.when(F.size("by_line") > 0, F.col("by_line")).otherwise(F.col("companies"))
    return whole.join(by_line, key, "left").select(key, chosen.alias("gold_companies"))


def gold_records(gold: DataFrame, aliases: DataFrame, counties: DataFrame) -> DataFrame:
    """Gold rows (question_number, question, golden_answer) with type, fields, count, companies, counties and numbers."""
    key, answer = "question_number", F.col("golden_answer")
    # The count of a gold answer is said in prose: a label isn't looked for.
    count = extract_count(F.regexp_replace(answer, r"(?im)^\s*Count:", " "))
    out = gold.join(gold_companies(gold, key, "golden_answer", aliases), key).join(counties_in(gold, [key], "golden_answer", counties).withColumnRenamed("counties", "gold_counties"), key)
    out = out.withColumns({"question_type": question_type(F.col("question")), "judge_recommended": judge_recommended(F.col("question")), "requested_fields": requested_fields(F.col("question")), "gold_count": count})
    numbers = F.array_remove(extract_numbers(answer), F.coalesce(F.col("gold_count").cast("string"), F.lit("")))
    return out.withColumn("gold_numbers", sorted_numbers(numbers))


def unknown_mentions(answers: DataFrame, keys: list[str], aliases: DataFrame, response: str = "response", lengths: list[int] | None = None) -> DataFrame:
    """(keys, mention): company-like phrases of a text that are no label, name no known company and are part of no alias."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(response), F.lit("")), F.lit(COMPANY_PHRASE), F.lit(1)), lambda x: F.regexp_replace(x, r"^[ .,:;|]+|[ .,:;|]+$", ""))
    rows = answers.select(*keys, F.explode(F.array_distinct(found)).alias("mention"))
    short = norm_company(F.col("mention"))
    rows = rows.filter((F.length(short) >= 4) & ~short.isin(*LABELS) & ~norm(F.col("mention")).isin(*LABELS))
    texts = companies_in(rows.select("mention").distinct(), ["mention"], "mention", aliases, lengths).filter(F.size("companies") == 0).select("mention", short.alias("short"))
    part = part_of_any(texts, "mention", "short", aliases, "alias")
    return rows.join(texts.select("mention"), "mention", "left_semi").join(part, "mention", "left_anti").select(*keys, "mention")


def part_of_any(texts: DataFrame, key: str, short: str, aliases: DataFrame, alias: str) -> DataFrame:
    """(key) of the texts whose short form, of RUN characters or more, is part of some alias.

    A text that is part of an alias has all its runs of RUN characters there: they meet by the run that the fewest
    aliases have, an equality join, and contains() verifies."""
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (RUN - 1)), lambda i: F.substring(c, i, F.lit(RUN))))
    held = aliases.select(F.col(alias).alias("__whole")).distinct().filter(F.length("__whole") >= RUN).select("__whole", F.explode(runs(F.col("__whole"))).alias("__run"))
    often = held.groupBy("__run").agg(F.count("*").alias("__n"))
    asked = texts.filter(F.length(short) >= RUN).select(key, F.col(short).alias("__short"), F.explode(runs(F.col(short))).alias("__run"))
    rarest = asked.join(often, "__run", "left").groupBy(key, "__short").agg(F.min_by("__run", F.struct(F.coalesce("__n", F.lit(0)), "__run")).alias("__run"))
    return rarest.join(held, "__run").filter(F.contains("__whole", "__short")).select(key).distinct()
