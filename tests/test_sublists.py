"""Lists of words in texts, against looking at every place."""

import random

from scoreloom.operators.sublists import sublists
from scoreloom.sources.stored import stored


def by_hand(phrases, texts):
    out = set()
    for p in {p for p in phrases if p and p.split(" ") != [""]}:
        w = [x for x in p.split(" ") if x]
        for t in {t for t in texts if t}:
            v = [x for x in t.split(" ") if x]
            at = tuple(i for i in range(len(v)) if w and v[i : i + len(w)] == w)
            if at:
                out.add((p, t, at))
    return out


def test_sublists_equal_looking_at_every_place(spark):
    rand = random.Random(6)
    words = ["a", "ab", "b", "ba", "é", "a-b", "漢", "z"]
    for few in (2, 8):
        make = lambda n: " ".join(rand.choices(words[:few], k=n))
        texts = [make(rand.randint(1, 30)) for _ in range(120)] + [None, "", " ", "a a a a", "ab  b", "z"]
        phrases = [make(rand.randint(1, 6)) for _ in range(150)] + [None, "", "a", "a", "a a", "nowhere", texts[0]]
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # all partitions, however small
        try:
            got = sublists(spark.createDataFrame([(p,) for p in phrases], "phrase string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert {(r.phrase, r.text, tuple(r.starts)) for r in got} == by_hand(phrases, texts) and len(got) == len({(r.phrase, r.text) for r in got})


def test_rows_are_one_a_word(spark):
    kept = []

    def keep(df):
        kept.append(stored(df))
        return kept[-1]

    long = " ".join(f"w{i}" for i in range(3000))
    found = sublists(spark.createDataFrame([("w7 w8",), ("w2998 w2999",), ("w8 w7",)], "phrase string"), spark.createDataFrame([(long,)], "text string"), keep)
    assert {(r.phrase, tuple(r.starts)) for r in found.collect()} == {("w7 w8", (7,)), ("w2998 w2999", (2998,))}
    assert kept[0].count() == 3000
    none = sublists(spark.createDataFrame([], "phrase string"), spark.createDataFrame([(long,)], "text string"))
    assert none.count() == 0 and sublists(spark.createDataFrame([("a",)], "phrase string"), spark.createDataFrame([], "text string")).count() == 0


def test_suffixes_carry_no_texts(spark):
    """What is written of the suffixes grows with the words of the texts, not with words times text."""
    kept = []
    found = sublists(spark.createDataFrame([("b c",)], "phrase string"), spark.createDataFrame([("a b c b c",)], "text string"), lambda df: kept.append(df.columns) or stored(df))
    assert "key" in kept[-1] and "text" not in kept[-1] and [tuple(r) for r in found.collect()] == [("b c", "a b c b c", [1, 3])]
