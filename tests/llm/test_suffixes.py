"""Operator 13: suffix arrays against sorting, removal against looking at every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import queries, suffixes

SPAN = suffixes.SPAN


def by_hand(texts):
    bodies = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    seen = Counter(b[i : i + SPAN] for b in bodies for i in range(len(b) - SPAN + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - SPAN + 1):
            if seen[b[i : i + SPAN]] > 1:
                gone[i] += 1
                gone[i + SPAN] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        n = int(gone.sum())
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((len(b), n, spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def digests(df):
    return df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))


def same(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [tuple(r)[1:] for r in sorted(digests(suffixes.without_repeats(df, **how)).collect())]
    assert got == by_hand(texts)


def test_suffix_arrays_equal_sorting():
    rand = random.Random(2)
    cases = [[], [1], [1] * 50, [1, 2] * 40, [2, 1] * 40, [0, 0, 1], list(range(30)), list(range(30))[::-1], [1, 1, 2] * 20 + [1, 1]]
    cases += [[rand.randrange(k) for _ in range(rand.randrange(120))] for k in (1, 2, 2, 3, 5, 50) for _ in range(150)]
    fib = [[1], [1, 0]]
    while len(fib[-1]) < 500:
        fib.append(fib[-1] + fib[-2])
    for s in [*cases, fib[-1], [x for k in range(9) for x in [0] * k + [1]] * 3]:
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:]), s


def noise(rand, n):
    return "".join(rand.choices("abcdefgh ", k=n))


def planted(seed):
    rand = random.Random(seed)
    passage, long = noise(rand, 700), noise(rand, 3000)
    texts = [noise(rand, rand.randrange(1500)) for _ in range(30)]
    for _ in range(25):  # passages cut at odd places, in different neighbours
        a = rand.randrange(250)
        texts.append(noise(rand, rand.randrange(60)) + passage[a : a + rand.randrange(390, 450)] + noise(rand, rand.randrange(60)))
    for _ in range(12):  # near copies
        at = rand.randrange(2900)
        texts.append(long[:at] + noise(rand, rand.randrange(3)) + long[at + rand.randrange(3) :])
    period = noise(rand, 37)
    return texts + ["x" * 399, "x" * 400, "y" * 401, "z" * 3000, period * 40, period * 11, noise(rand, 5) + period * 30, None, "", "ä漢😀" * 200, "ä漢😀" * 150 + "q", passage, passage, passage[:400], passage[:399], long + long[:500]]


@pytest.mark.parametrize("seed", range(3))
def test_removal_equals_looking_at_every_string(spark, seed):
    same(spark, planted(seed))


def test_big_groups_are_cut_by_longer_anchors(spark):
    same(spark, planted(7), group=2)
    rand = random.Random(9)
    hot = noise(rand, 380)
    texts = [noise(rand, 300) + rand.choice("ab") * rand.randrange(4) + hot + rand.choice("ab") * rand.randrange(30) + noise(rand, 300) for _ in range(60)]
    same(spark, texts, group=5)


def test_parts_of_long_texts_and_arrays(spark):
    rand = random.Random(4)
    data = noise(rand, 5000).encode()
    whole = suffixes.string_hashes(np.frombuffer(data, np.uint8), 128)
    assert len(set(whole.tolist())) == len(whole) == 5000 - 127
    assert (suffixes.string_hashes(np.frombuffer(data[100:], np.uint8), 128) == whole[100:]).all()
    passage = noise(rand, 900)
    long = noise(rand, (1 << 20) - 450) + "1" + passage + "2" + noise(rand, (1 << 20) - 300) + "3" + passage + "4" + noise(rand, 3000)
    rows = suffixes.without_repeats(spark.createDataFrame([(1, long), (2, "k" + passage)], "doc_id long, text string")).collect()
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in rows}
    one, two = long.index(passage), long.rindex(passage)
    assert spans[2] == [(1, 901)] and spans[1] == [(one, one + 900), (two, two + 900)]


def test_odd_tables(spark, odd_docs, no_docs, docs, sf):
    for df in (odd_docs, docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = sorted(((i, *x) for (i, _), x in zip(rows, by_hand([t for _, t in rows]))), key=repr)
        assert sorted(map(tuple, digests(suffixes.without_repeats(df)).collect()), key=repr) == want
    assert suffixes.without_repeats(no_docs).count() == 0
    clash = spark.createDataFrame([(1, "a" * 500, 1, 2, 3)], "doc_id long, text string, a int, id int, body int")
    assert suffixes.without_repeats(clash).collect()[0].kept == b""
    out = queries.QUERIES["op13_suffix_array_dedup"](spark, sf)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and out.count() == docs.count()
