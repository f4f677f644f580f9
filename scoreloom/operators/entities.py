"""Companies and counties named in texts: an equality join of token n-grams with aliases, then greedy spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, norm, norm_company


def alias_table(kb: DataFrame, company: str = "Company", order: str = "row_id") -> DataFrame:
    """(company, alias, kb_ord): the names of each company, with and without what stands in brackets, of 3 letters or
    more; and its name without broad suffixes, of two words and 4 letters or more, if no other company has this one.

    kb_ord: the company's first place in the table."""
    firms = kb.filter(F.col(f"`{company}`").isNotNull()).groupBy(F.col(f"`{company}`").alias("company")).agg(F.min(order).alias("kb_ord"))
    bare = F.regexp_replace("company", r"\([^)]*\)", " ")
    primary = firms.select("company", "kb_ord", F.explode(F.array_distinct(F.array(norm(F.col("company")), norm(bare)))).alias("alias")).filter(F.length("alias") >= 3)
    loose = firms.select("company", "kb_ord", F.explode(F.array_distinct(F.array(norm_company(F.col("company")), norm_company(bare)))).alias("alias"))
    loose = loose.filter((F.length("alias") >= 4) & F.col("alias").contains(" "))
    shared = ambiguous_aliases(primary, loose).select("alias")
    return primary.unionByName(loose.join(shared, "alias", "left_anti").select("company", "kb_ord", "alias")).distinct()


def ambiguous_aliases(primary: DataFrame, loose: DataFrame) -> DataFrame:
    """(alias, owners): loose names that more than one company has, or that are another's full name."""
    both = loose.select("alias", "company").unionByName(primary.join(loose.select("alias").distinct(), "alias", "left_semi").select("alias", "company"))
    return both.groupBy("alias").agg(F.count_distinct("company").alias("owners")).filter("owners > 1")


def _grams(tokens: Column, longest: int) -> Column:
    """(start, stop, gram) of all runs of 1 to longest tokens; start and stop count tokens, so texts of any length cost
    in proportion. Runs of the same start are the longer the more tokens they have."""

    def runs(t: Column) -> Column:
        def each(n: int) -> Column:
            at = F.sequence(F.lit(0), F.size(t) - n)
            return F.transform(at, lambda i: F.struct(i.alias("start"), (i + n).alias("stop"), F.array_join(F.slice(t, i + 1, F.lit(n)), " ").alias("gram")))

        none = F.array().cast("array<struct<start:int,stop:int,gram:string>>")
        return F.flatten(F.array(*[F.when(F.size(t) >= n, each(n)).otherwise(none) for n in range(1, longest + 1)]))

    return let(tokens, runs)


def _key(tokens: Column, at: Column | int, n: int) -> list[Column]:
    """Two hashes (64 and 32 bits) of n tokens from a position: what runs of words meet by, instead of their text."""
    run = [F.get(tokens, F.lit(at + k) if isinstance(at, int) else at + k) for k in range(n)]
    return [F.xxhash64(F.lit(n), *run).alias("key"), F.hash(*run, F.lit(n)).alias("check")]


def lengths_of(aliases: DataFrame, alias: str = "alias") -> list[int]:
    """The numbers of words that aliases have: a few."""
    return sorted(r[0] for r in aliases.select(F.size(F.split(alias, " ")).alias("n")).distinct().collect())


def occurrences(texts: DataFrame, keys: list[str], text: str, aliases: DataFrame, alias: str = "alias", lengths: list[int] | None = None) -> DataFrame:
    """Rows of aliases found in the texts as whole tokens: keys, start, stop and the aliases' columns.

    Texts are cut into runs of as many tokens as aliases have (lengths: lengths_of(aliases), if it is known); an equality
    join of hashes meets them with the aliases. Spark broadcasts these only where its size check allows."""
    words = F.split(alias, " ")
    lengths = lengths_of(aliases, alias) if lengths is None else lengths
    if not lengths:
        return texts.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("stop")).limit(0).join(aliases.limit(0), F.lit(False))
    none = F.array().cast("array<struct<start:int,stop:int,key:bigint,check:int>>")

    def runs(t: Column) -> Column:
        def each(n: int) -> Column:
            at = F.sequence(F.lit(0), F.size(t) - n)
            return F.when(F.size(t) >= n, F.transform(at, lambda i: F.struct(i.alias("start"), (i + n).alias("stop"), *_key(t, i, n)))).otherwise(none)

        return F.flatten(F.array(*[each(n) for n in lengths])) if len(lengths) > 1 else each(lengths[0])

    asked = aliases
    for c, k in (("key", 0), ("check", 1)):
        value = F.coalesce(*[F.when(F.size(words) == n, _key(words, 0, n)[k]) for n in lengths])
        asked = asked.withColumn(f"__{c}", value)
    grams = texts.select(*keys, F.explode(let(F.split(norm(F.col(text)), " "), runs)).alias("g")).select(*keys, "g.start", "g.stop", "g.key", "g.check")
    return grams.join(asked, (F.col("key") == F.col("__key")) & (F.col("check") == F.col("__check"))).drop("key", "check", "__key", "__check")


def greedy(spans: Column) -> Column:
    """Of (start, stop, kb_ord, company) spans those that a pass from the left keeps: at each start the longest, of
    equal ones the first in the table, none that begins before the last one kept has ended."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kb_ord"].alias("kb_ord"), s["company"].alias("company"))))
    kind = "array<struct<start:int,stop:int,company:string>>"
    seed = F.struct(F.lit(0).alias("last"), F.array().cast(kind).alias("kept"))

    def step(a: Column, s: Column) -> Column:
        kept = F.struct(s["start"].cast("int").alias("start"), (-s["back"]).cast("int").alias("stop"), s["company"].alias("company"))
        taken = F.struct((-s["back"]).cast("int").alias("last"), F.concat(a["kept"], F.array(kept)).alias("kept"))
        return F.when(s["start"] >= a["last"], taken).otherwise(a)

    return F.aggregate(ordered, seed, step, lambda a: a["kept"])


def companies_in(texts: DataFrame, keys: list[str], text: str, aliases: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """keys and companies (sorted, distinct) for every row of texts; texts that name none have an empty array."""
    found = occurrences(texts, keys, text, aliases, lengths=lengths).groupBy(*keys).agg(F.collect_list(F.struct("start", "stop", "kb_ord", "company")).alias("spans"))
    named = found.select(*keys, F.array_sort(F.array_distinct(F.transform(greedy(F.col("spans")), lambda s: s["company"]))).alias("companies"))
    return texts.select(*keys).join(named, keys, "left").withColumn("companies", F.coalesce("companies", F.array().cast("array<string>")))


def counties_in(texts: DataFrame, keys: list[str], text: str, counties: DataFrame) -> DataFrame:
    """keys and counties (sorted, distinct) for every row; counties: (county, alias). Overlaps all count."""
    found = occurrences(texts, keys, text, counties).groupBy(*keys).agg(F.array_sort(F.collect_set("county")).alias("counties"))
    return texts.select(*keys).join(found, keys, "left").withColumn("counties", F.coalesce("counties", F.array().cast("array<string>")))
