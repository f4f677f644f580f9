"""Mentions of companies in answers: collected, kept once, and classified by a cascade of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import evidence_rows, section
from ..functions.fuzzy import best_of, ratio
from ..functions.text import COMPANY_LIKE, COMPANY_PHRASE, FUZZY_MIN_LENGTH, FUZZY_THRESHOLD, GENERIC_PHRASES, SECTIONS, canonical_key, let, norm, norm_company
from ..sources.stored import stored
from .entities import _grams, companies_in, occurrences
from .nearness import deletions

# Fields that a candidate may be a value of, and the classes.
OTHER_FIELDS = ("Primary OEMs", "Category", "Primary Facility Type", "Supplier or Affiliation Type", "EV Supply Chain Role", "Classification Method")
CLASSES = (
    "known_kb_company", "misspelled_kb_company", "true_out_of_kb_hallucination", "industry_group_false_positive", "product_service_false_positive",
    "kb_supported_non_company_field", "not_a_company_phrase",
)
#: Names compared in one step of nearest_of_all.
NAME_BLOCK = 256


def mentions(answers: DataFrame, keys: list[str], response: str = "response") -> DataFrame:
    """(keys, ord, mention_key, mention_text, sources): each company that an answer's Evidence table or Answer section
    (without one, its first 800 characters) mentions, once a key, as first met."""
    body = F.coalesce(F.nullif(section(F.col(response), "Answer"), F.lit("")), F.left(F.coalesce(F.col(response), F.lit("")), F.lit(800)))
    prose = F.transform(F.regexp_extract_all(body, F.lit(COMPANY_PHRASE), F.lit(1)), lambda x: F.regexp_replace(x, r"^[ .,:;|]+|[ .,:;|]+$", ""))
    named = F.concat(
        F.transform(evidence_rows(F.col(response)), lambda r: F.struct(r["company"].alias("text"), F.lit("evidence_company").alias("source"))),
        F.transform(prose, lambda x: F.struct(x.alias("text"), F.lit("answer_prose").alias("source"))),
    )
    rows = answers.select(*keys, F.posexplode(named).alias("ord", "m")).select(*keys, "ord", "m.text", "m.source")
    key = F.coalesce(F.nullif(canonical_key(F.col("text")), F.lit("")), norm(F.col("text")))
    grouped = rows.withColumn("mention_key", key).filter("mention_key <> ''").groupBy(*keys, "mention_key")
    first = F.array_sort(F.collect_list(F.struct("ord", "text", "source")))
    return grouped.agg(first.alias("all")).select(
        *keys, F.col("all")[0]["ord"].alias("ord"), "mention_key", F.col("all")[0]["text"].alias("mention_text"), F.col("all")[0]["source"].alias("first_source"),
        F.array_distinct(F.transform("all", lambda s: s["source"])).alias("sources"),
    )


def _field_hits(asked: DataFrame, kb: DataFrame) -> DataFrame:
    """(cand_norm, rank, kind, field, value, part) of the candidates of asked (cand_norm) that are a value of a field of
    the knowledge table, or (two words or more) follow each other in one.

    Values are cut into runs of as many words as candidates have, so that a long value costs in proportion."""
    kinds = [("Industry Group", "industry_group_false_positive"), ("Product / Service", "product_service_false_positive"), *[(f, "kb_supported_non_company_field") for f in OTHER_FIELDS]]
    cells = [
        F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(field).alias("field"), norm(F.col(f"`{field}`").cast("string")).alias("value"))
        for rank, (field, kind) in enumerate(kinds) if field in kb.columns
    ]
    none = F.array().cast("array<struct<rank:int,kind:string,field:string,value:string>>")
    values = kb.select(F.explode(F.array(*cells) if cells else none).alias("v")).select("v.*").filter("value <> ''").distinct()
    whole = asked.join(values, F.col("cand_norm") == F.col("value")).select("cand_norm", "rank", "kind", "field", "value", F.lit(0).alias("part"))
    several = asked.filter(F.size(F.split("cand_norm", " ")) >= 2)
    inside = occurrences(values, ["rank", "kind", "field", "value"], "value", several, "cand_norm").filter("cand_norm <> value")
    return whole.unionByName(inside.select("cand_norm", "rank", "kind", "field", "value", F.lit(1).alias("part")))


def classify(found: DataFrame, keys: list[str], kb: DataFrame, aliases: DataFrame, keep=stored, report_nearest: bool = False, lengths: list[int] | None = None) -> DataFrame:
    """found with classification, matched_kb_company, similarity, match_kind, matched_field and matched_value.

    lengths: those of the aliases, if they are known. report_nearest: made-up names carry the nearest company below the threshold too, found by nearest_of_all.

    Candidates are classified once a text and source. The steps, each an equality join (n-grams of the knowledge
    table's values, not a comparison of all with all): generic phrase, known company, value of another field, near
    spelling (over blocks of names), part of a name, company-like, else no company."""
    tidy = F.regexp_replace(F.regexp_replace(F.col("mention_text"), r"\s+", " "), r"^[*`\"' .,:;|]+|[*`\"' .,:;|]+$", "")
    found = keep(found)  # read once for its texts and once for its rows
    texts = found.select("mention_text", "first_source").distinct().withColumn("cand", tidy)
    texts = texts.withColumns({"cand_norm": norm(F.col("cand")), "cand_key": canonical_key(F.col("cand"))})
    labels = kb.sparkSession.createDataFrame([(c,) for c in [*SECTIONS, "row_id", *kb.columns]], "label string").select(norm(F.col("label")).alias("label")).distinct()
    generic = texts.select("cand_norm").distinct().join(labels, F.col("cand_norm") == F.col("label"), "left_semi").withColumn("is_label", F.lit(True))
    texts = texts.join(generic, "cand_norm", "left").withColumn("generic", F.coalesce("is_label", F.lit(False)) | F.col("cand_norm").isin(*GENERIC_PHRASES) | (F.col("cand_key") == "")).drop("is_label")

    known = companies_in(texts.select("cand").distinct(), ["cand"], "cand", aliases, lengths).select("cand", F.get("companies", F.lit(0)).alias("known"))
    texts = keep(texts.join(known, "cand", "left"))

    field = texts.filter(~F.col("generic") & F.col("known").isNull() & (F.length("cand_norm") >= 5)).select("cand_norm").distinct()
    hits = _field_hits(field, kb)
    # Products: the longest value first; others: whole values before parts, then the smallest value.
    order = F.struct("rank", F.when(F.col("rank") == 1, F.lit(0)).otherwise(F.col("part")), F.when(F.col("rank") == 1, -F.length("value")).otherwise(F.lit(0)), "value")
    best = hits.groupBy("cand_norm").agg(F.min_by(F.struct("kind", "field", "value"), order).alias("hit"))
    texts = keep(texts.join(best, "cand_norm", "left"))

    names = kb.filter("Company is not null").groupBy("Company").agg(F.min("row_id").alias("kb_ord")).withColumn("kb_key", canonical_key(F.col("Company"))).filter("kb_key <> ''")
    open_keys = texts.filter(~F.col("generic") & F.col("known").isNull() & F.col("hit").isNull()).select("cand_key").distinct()
    asked = open_keys.filter(F.length("cand_key") >= FUZZY_MIN_LENGTH)
    texts = texts.join(nearest_of_all(asked, names) if report_nearest else nearest(asked, names, keep=keep), "cand_key", "left")

    longest = names.agg(F.max(F.size(F.split("kb_key", " ")))).first()[0] or 1
    pieces = names.select("Company", "kb_ord", F.explode(_grams(F.split("kb_key", " "), longest)).alias("g")).select(F.col("g.gram").alias("cand_key"), "Company", "kb_ord")
    telling = F.exists(F.split("cand_key", " "), lambda t: F.length(t) >= 4)
    part = open_keys.filter(telling).join(pieces, "cand_key").groupBy("cand_key").agg(F.min_by("Company", "kb_ord").alias("part_of"))
    texts = texts.join(part, "cand_key", "left")

    company_like = F.col("cand").rlike(COMPANY_LIKE) | (F.col("first_source") == "evidence_company")
    steps = [
        (F.col("generic"), "not_a_company_phrase", None, None, None),
        (F.col("known").isNotNull(), "known_kb_company", F.col("known"), F.lit(1.0), "exact"),
        (F.col("hit").isNotNull(), None, None, None, None),
        (F.col("score") >= FUZZY_THRESHOLD, "misspelled_kb_company", F.col("near"), F.bround("score", 4), "fuzzy"),
        (F.col("part_of").isNotNull(), "known_kb_company", F.col("part_of"), None, "partial"),
        (company_like, "true_out_of_kb_hallucination", F.col("near"), F.bround("score", 4), None),
        (F.lit(True), "not_a_company_phrase", None, None, None),
    ]

    def cascade(k: int, kind: str):
        out = F.lit(None).cast(kind)
        for test, *made in reversed(steps):
            value = made[k]
            if k == 0 and value is None:
                value = F.col("hit.kind")
            value = F.lit(None).cast(kind) if value is None else F.lit(value) if isinstance(value, str) else value
            out = F.when(test, value).otherwise(out)
        return out

    made = texts.select(
        "mention_text", "first_source", cascade(0, "string").alias("classification"), cascade(1, "string").alias("matched_kb_company"), cascade(2, "double").alias("similarity"),
        cascade(3, "string").alias("match_kind"), F.when(~F.col("generic") & F.col("known").isNull(), F.col("hit.field")).alias("matched_field"),
        F.when(~F.col("generic") & F.col("known").isNull(), F.col("hit.value")).alias("matched_value"),
    )
    return found.join(made, ["mention_text", "first_source"])


def _pairs_of(text) -> object:
    """The pairs of neighbouring characters of a text, each with its number among equal ones."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.length(text) >= 2, let(pairs, lambda p: F.transform(p, lambda x, i: F.concat(x, F.size(F.filter(F.slice(p, 1, i), lambda y: y == x)).cast("string"))))).otherwise(F.array().cast("array<string>"))


def nearest(keys: DataFrame, names: DataFrame, least: float = FUZZY_THRESHOLD, keep=stored) -> DataFrame:
    """(cand_key, near, score): of the names with a ratio of `least` or more the one of the highest for each key, of
    equal ones the first in the table. Keys without such a name have no row.

    Names that lack one character of the key, or have one more, come first (_one_apart). Any other name of a key of n
    characters leaves two or more of both unmatched, so that its ratio is n / (n + 1) at most: keys with a better one
    are done, however many names lie above the threshold. For the others, a ratio of least bounds both lengths, and with M matching characters in at most n - 2 M + 1 blocks (n: both
    lengths together) at least 3 M - n - 1 pairs of neighbouring characters are common. So keys and names meet by
    the rarest of these pairs only (as many of each as leave fewer than that out), an equality join; what lengths
    and common pairs allow is compared in full. Every name above the threshold is among that."""
    low, high = least / (2 - least), (2 - least) / least

    def prefix(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
        n = F.length(text)
        wanted = F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * (n + F.ceil(low * n - 1e-9)) - 1 - 1e-9))
        grams = df.withColumn("__pairs", _pairs_of(F.col(text))).withColumn("__take", F.size("__pairs") - wanted + 1)
        long = grams.select(*keep, "__pairs", "__take", F.explode("__pairs").alias("__pair")).join(often, "__pair", "left")
        ranked = long.groupBy(*keep, "__pairs", "__take").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__pair").alias("p")))).alias("__all"))
        return ranked.select(*keep, "__pairs", F.explode(F.transform(F.slice("__all", F.lit(1), F.greatest(F.lit(0), F.col("__take").cast("int"))), lambda x: x["p"])).alias("__pair"))

    names = names.groupBy("kb_key").agg(F.min("kb_ord").alias("kb_ord"), F.min_by("Company", "kb_ord").alias("Company"))
    keys = keys.select("cand_key").distinct()
    n = F.length("cand_key")
    done = keep(_best(_listed(_one_apart(keys, names))).filter((F.col("score") > n / (n + 1) + 1e-9) & (F.col("score") >= least)))
    keys = keys.join(done.select("cand_key"), "cand_key", "left_anti")

    often = names.select("kb_key").distinct().select(F.explode(_pairs_of(F.col("kb_key"))).alias("__pair")).groupBy("__pair").agg(F.count("*").alias("__n"))
    left = prefix(keys, "cand_key", ["cand_key"]).withColumnRenamed("__pairs", "__mine")
    right = prefix(names, "kb_key", ["kb_key", "kb_ord", "Company"])
    a, b = F.length("cand_key"), F.length("kb_key")
    fits = b.between(F.ceil(low * a - 1e-9), F.floor(high * a + 1e-9)) & (F.size(F.array_intersect("__mine", "__pairs")) >= (1.5 * least - 1) * (a + b) - 1 - 1e-9)
    met = left.join(right.hint("merge"), "__pair").filter(fits).groupBy("cand_key", "kb_key").agg(F.min("kb_ord").alias("kb_ord"), F.first("Company").alias("Company"))
    return done.unionByName(_best(_listed(met)).filter(F.col("score") >= least))


def _one_apart(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(cand_key, kb_key, kb_ord, Company), once each, of names (one a kb_key) that are the key, or are it but for one
    character that one of the two has more. Meets by 64 bits: a pair too many, if ever, is scored like all others."""
    def cut(c: str):  # noqa: E306
        return F.explode(F.transform(deletions(F.col(c), 1), lambda t: F.xxhash64(t))).alias("__short")

    # Merged: Spark takes exploded rows for as small as what they are made of, and would broadcast them.
    some = names.select("kb_key", "kb_ord", "Company")
    less = keys.select("cand_key", cut("cand_key")).join(some.withColumn("__short", F.xxhash64("kb_key")).hint("merge"), "__short")
    more = keys.withColumn("__short", F.xxhash64("cand_key")).join(some.select("*", cut("kb_key")).hint("merge"), "__short")
    return less.unionByName(more).select("cand_key", "kb_key", "kb_ord", "Company").distinct()


def _listed(met: DataFrame) -> DataFrame:
    return met.groupBy("cand_key").agg(F.array_sort(F.collect_list(F.struct("kb_ord", "kb_key", "Company"))).alias("names"))


def _best(asked: DataFrame) -> DataFrame:
    """(cand_key, score, near) of rows (cand_key, names): the best over all rows of a key."""
    scored = asked.withColumn("best", best_of(F.col("cand_key"), F.transform("names", lambda s: s["kb_key"])))
    hit = F.get("names", F.col("best.at"))
    return scored.filter("best.at is not null").groupBy("cand_key").agg(
        F.max(F.col("best.score")).alias("score"), F.max_by(hit["Company"], F.struct(F.col("best.score"), -hit["kb_ord"])).alias("near")
    )


def nearest_of_all(keys: DataFrame, names: DataFrame) -> DataFrame:
    """(cand_key, near, score): the name of highest ratio for each key, however low; of equal ones the first.

    Costs keys times names. For reports on tables of some thousands of names; nearest() is what classification needs.
    Names go in blocks of NAME_BLOCK, a row a block, so no side has to fit one machine."""
    blocks = max(1, -(-names.count() // NAME_BLOCK))
    rows = names.groupBy(F.pmod(F.xxhash64("Company"), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("kb_ord", "kb_key", "Company"))).alias("names"))
    asked = keys.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    return _best(asked.join(rows, "block"))


def class_counts(classified: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """A row an answer with the number of its mentions of each class, and of those that its Evidence table has; zeros without mentions."""
    by_evidence = F.count_if(F.array_contains("sources", "evidence_company")).alias("evidence_company_mentions")
    counts = classified.groupBy(*keys).agg(*[F.count_if(F.col("classification") == c).alias(f"n_{c}") for c in CLASSES], by_evidence)
    return answers.select(*keys).join(counts, keys, "left").na.fill(0, [*[f"n_{c}" for c in CLASSES], "evidence_company_mentions"])


def row_id_checks(answers: DataFrame, keys: list[str], kb: DataFrame, aliases: DataFrame, response: str = "response", keep=stored, lengths: list[int] | None = None) -> DataFrame:
    """A row for each Evidence row with a row id: whether the company there is the one of the knowledge table's row.

    Cited ids are read in as many digits as the table's greatest has, four at least. Near spellings are looked at only
    for rows that nothing plainer has matched."""
    digits = max(4, len(str(kb.agg(F.max("row_id")).first()[0] or 0)))
    rows = answers.select(*keys, F.posexplode(evidence_rows(F.col(response), digits)).alias("ord", "e")).select(*keys, "ord", F.col("e.company").alias("claimed_company"), F.col("e.row_id").alias("cited_row_id"))
    rows = rows.filter("cited_row_id is not null")
    joined = rows.join(kb.select(F.col("row_id").alias("cited_row_id"), F.trim("Company").alias("kb_company"), F.lit(True).alias("found")), "cited_row_id", "left")
    named = companies_in(joined.select("claimed_company").distinct(), ["claimed_company"], "claimed_company", aliases, lengths)
    joined = joined.join(named, "claimed_company", "left")
    c, k = F.col("claimed_company"), F.col("kb_company")
    plain = (
        F.when(F.col("found").isNull() | (norm(k) == ""), "bad_row_id")
        .when((norm(c) == norm(k)) | (norm_company(c) == norm_company(k)), "exact")
        .when(F.array_contains("companies", k), "alias")
    )
    staged = keep(joined.withColumn("plain", plain))
    near = staged.filter("plain is null").select("claimed_company", "kb_company").distinct().withColumn("near", ratio(canonical_key(c), canonical_key(k)))
    out = staged.join(near, ["claimed_company", "kb_company"], "left")
    fuzzy = F.col("near") >= FUZZY_THRESHOLD
    status = F.when(F.col("plain") == "bad_row_id", "bad_row_id").when(F.col("plain").isNotNull() | fuzzy, "match").otherwise("mismatch")
    kind = F.when(F.col("plain").isin("exact", "alias"), F.col("plain")).when(fuzzy, F.concat(F.lit("fuzzy:"), F.bround("near", 3).cast("string")))
    return out.select(*keys, "ord", "claimed_company", "cited_row_id", F.col("kb_company").alias("kb_company_at_row_id"), status.alias("status"), kind.alias("match_type"))


