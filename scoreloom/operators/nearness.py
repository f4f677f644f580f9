"""Texts that hold a passage, and names a few edits apart, by equality joins that lose nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: Words of a passage's inside that lead to it, and characters of a passage without an inside.
RUN, HEAD = 5, 16


def _word_hashes(c: Column) -> Column:
    return F.transform(F.split(c, " ", -1), lambda w: F.xxhash64(w))


def _runs(text: Column, n: int) -> Column:
    """Hashes of all runs of n words, each word hashed once; none for shorter texts."""

    def each(words: Column) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(F.lit(n), *[words[i + k] for k in range(n)])))

    return let(_word_hashes(text), each)


def _windows(text: Column, n: int) -> Column:
    """Hashes of all windows of n characters."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.xxhash64(F.lit(-n), F.substring(text, i, F.lit(n)))))


def passages_in(texts: DataFrame, key: str, text: str, passages: DataFrame, item: str, passage: str) -> DataFrame:
    """(key, item), once each, of texts that hold the passage as contains() says; empty and null passages are nowhere.

    The words between a passage's first and last, which stand whole in any text that holds it, meet the texts' runs of
    as many words, up to RUN; passages of one or two words meet windows of their first HEAD characters. Only the
    numbers of words and characters that passages have are looked for: RUN and HEAD kinds at most. contains() decides.
    Keys that repeat are told apart by their text."""
    asked = passages.select(F.col(item).alias("__item"), F.col(passage).alias("__passage")).filter("__passage <> ''")
    inside = F.least(F.size(F.split("__passage", " ", -1)) - 2, F.lit(RUN))
    asked = asked.withColumn("__n", F.when(inside > 0, inside).otherwise(-F.least(F.length("__passage"), F.lit(HEAD))))
    kinds = sorted(r[0] for r in asked.select("__n").distinct().collect())
    leads = [F.when(F.col("__n") == n, F.xxhash64(F.lit(n), *[F.get(_word_hashes(F.col("__passage")), F.lit(1 + k)) for k in range(n)]) if n > 0 else F.xxhash64(F.lit(n), F.left("__passage", F.lit(-n)))) for n in kinds]
    asked = asked.withColumn("__lead", F.coalesce(*leads, F.lit(None).cast("bigint")))
    none = F.array().cast("array<bigint>")
    made = [F.coalesce(_runs(F.col(text), n) if n > 0 else _windows(F.col(text), -n), none) for n in kinds]
    leads_of = F.explode(F.array_distinct(F.flatten(F.array(*made)) if made else none)).alias("__lead")
    rows = texts.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.xxhash64(text).alias("__of"))
    met = texts.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__of"), leads_of)
    hits = met.join(asked.select("__lead", "__item", "__passage"), "__lead").select("__key", "__of", "__item", "__passage").distinct()
    # A null key keeps its rows: equal nulls meet.
    found = hits.alias("h").join(rows.alias("r"), F.col("h.__key").eqNullSafe(F.col("r.__key")) & (F.col("h.__of") == F.col("r.__of"))).filter(F.contains("__text", "__passage"))
    return found.select(F.col("h.__key").alias(key), F.col("__item").alias(item)).distinct()


def _less_one(texts: Column) -> Column:
    """The texts of the array and all that lack one of their characters, once each."""
    each = F.transform(texts, lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array(t)))
    return F.array_distinct(F.concat(texts, F.flatten(each)))


def deletions(c: Column, most: int) -> Column:
    """The text and all texts that lack up to `most` of its characters: about length ** most / most! of them."""
    out = F.array(c)
    for _ in range(most):
        out = let(out, _less_one)
    return out


def within_edits(left: DataFrame, key: str, text: str, names: DataFrame, name: str, most: int = 2) -> DataFrame:
    """(key, text, name, distance) of all pairs of texts and distinct names at most `most` edits apart.

    Two texts so near have a text in common among those that lack up to `most` characters of each; levenshtein()
    decides. For names: the number of deletions grows with the length to the power of `most`. Nulls are near nothing."""
    hashes = lambda c: F.explode(F.transform(deletions(F.col(c), most), lambda t: F.xxhash64(t))).alias("__short")
    claims = left.select(F.col(text).alias("__text")).filter("__text IS NOT NULL").distinct()
    known = names.select(F.col(name).alias("__name")).filter("__name IS NOT NULL").distinct()
    # Merged, never broadcast: Spark takes the exploded names, some hundreds of rows each, for as small as the names.
    met = claims.select("__text", hashes("__text")).join(known.select("__name", hashes("__name")).hint("merge"), "__short").select("__text", "__name").distinct()
    near = met.withColumn("distance", F.levenshtein("__text", "__name")).filter(F.col("distance") <= most)
    return left.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(near, "__text").select(F.col("__key").alias(key), F.col("__text").alias(text), F.col("__name").alias(name), "distance")
