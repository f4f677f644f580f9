"""Operator 12 against counting by hand."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scoreloom.llm import phrases


def by_hand(rows, longest, least, share, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        here = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase)))
            inside = [b for longer, b in f.items() if len(longer) > len(phrase) and b >= least and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))]
            if not any(100 * b >= share * a for b in inside):
                here.append((score, a, " ".join(phrase), f[phrase[:k]], f[phrase[k:]]))
        here.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(here[:top])]
    return sorted(out)


def texts(seed, n):
    rand = random.Random(seed)
    words = ["The", "of", "new", "york", "City", "ß", "漢字", "x\x00", "É", "don't", "a-b"]
    return [(rand.choice(["en", "en", "en", "de", None]), None if rand.random() < 0.05 else "".join(rand.choice(words) + rand.choice([" ", " ", " ", "\t ", ". ", "\n", "? ", "\r", "\x0b", ","]) for _ in range(rand.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize(("longest", "block", "top"), [(3, 1 << 20, 2000), (3, 50, 7), (2, 100, 2000), (4, 300, 2000)])
def test_phrases_equal_counting(spark, longest, block, top):
    rows = texts(longest + block, 300)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.collocations(df, longest=longest, block=block, top=top, least=4)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, longest, 4, 50, top)


def test_phrases_of_odd_and_real_texts(odd_docs, docs):
    for df in (odd_docs, docs):
        rows = [(r.lang, r.text) for r in df.collect()]
        assert sorted(map(tuple, phrases.collocations(df).collect())) == by_hand(rows, 3, 10, 50, 2000)


def test_no_rows_and_many_languages(spark, no_docs):
    out = phrases.collocations(no_docs)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
    rows = [(f"l{i % 40}", "one two three. " * 3 + ("x " * (i % 5))) for i in range(400)]
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), block=16).collect()
    assert sorted(map(tuple, got)) == by_hand(rows, 3, 10, 50, 2000)


def test_lists_are_packed_and_unpacked():
    rand = np.random.default_rng(3)
    words = pa.array([f"w{int(x)}" for x in rand.zipf(1.3, 5000) % 400])
    positions = np.cumsum(rand.integers(1, 3, 5000)) + 70_000
    known, sizes, lists = phrases.inverted(words, positions)
    assert phrases._unpacked(phrases._packed(lists, sizes), sizes).tolist() == lists.tolist()
    one = phrases.Lists("en", known, sizes, lists)
    one.extend()
    at = dict(zip(positions.tolist(), words.to_pylist()))
    assert Counter(dict(zip(one.texts(np.arange(len(one.counts))).to_pylist(), one.counts.tolist()))) == Counter(f"{w} {at[p + 1]}" for p, w in at.items() if p + 1 in at)


def test_products_beyond_64_bits_are_exact(spark):
    f = 3_000_000_000_000
    up = spark.sql(f"select (1000000 * (cast({f} as decimal(19,0)) * cast({f} as decimal(19,0)))) div (cast({f + 1} as decimal(19,0)) * cast({f} as decimal(19,0))) s").first().s
    assert up == 1_000_000 * f * f // ((f + 1) * f)
