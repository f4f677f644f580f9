"""Passages in texts and names a few edits apart, against all pairs in plain Python."""

from itertools import product
from random import Random

from scoreloom.operators.nearness import deletions, passages_in, within_edits
from pyspark.sql import functions as F


def test_passages_of_every_length(spark):
    rng = Random(5)
    words = ["a", "ab", "b", "ba", "abc", "c", "", "é"]
    texts = [(i % 50, " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for i in range(80)] + [(None, "xab bax"), (None, "q"), (7, None), (8, "w " * 5000 + "a b c")]
    passages = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(60)] + [(100, "ab b"), (101, ""), (102, None), (103, "w w w w w w a b"), (104, "z" * 40), (None, "ab")]
    got = passages_in(spark.createDataFrame(texts, "k int, t string"), "k", "t", spark.createDataFrame(passages, "i int, p string"), "i", "p")
    want = {(k, i) for (k, t), (i, p) in product(texts, passages) if t is not None and p and p in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and len(want) > 100


def test_no_passages_and_no_texts(spark):
    texts, passages = spark.createDataFrame([(1, "a")], "k int, t string"), spark.createDataFrame([(1, "a")], "i int, p string")
    assert passages_in(texts, "k", "t", passages.limit(0), "i", "p").count() == 0
    assert passages_in(texts.limit(0), "k", "t", passages, "i", "p").count() == 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_all_names_within_edits(spark):
    rng = Random(3)
    make = lambda: "".join(rng.choices("abé", k=rng.randrange(0, 8)))
    claims, names = [(i, make()) for i in range(60)] + [(60, None), (0, "ab")], [make() for _ in range(60)] + ["ab", "ab", None]
    got = within_edits(spark.createDataFrame(claims, "k int, c string"), "k", "c", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    want = [(k, c, n, _edits(c, n)) for k, c in claims if c is not None for n in {n for n in names if n is not None} if _edits(c, n) <= 2]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_deletions(spark):
    one = spark.range(1).select(deletions(F.lit("abc"), 2).alias("d")).first().d
    assert sorted(one) == sorted({"abc", "ab", "ac", "bc", "a", "b", "c"})
