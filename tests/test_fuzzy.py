"""Ratios of matching blocks for arrays of pairs, against the standard library's matcher."""

import random
import time
from difflib import SequenceMatcher

from scoreloom.functions.fuzzy import ratios


def plain(lefts, rights):
    return [SequenceMatcher(None, a, b).ratio() for a, b in zip(lefts, rights)]


def names(rand, n, letters="abcdefghijklmnop  "):
    out = []
    for _ in range(n):
        a = "".join(rand.choices(letters, k=rand.randint(8, 30)))
        b = list(a)
        for _ in range(rand.randint(0, 8)):
            b[rand.randrange(len(b))] = rand.choice(letters)
        out.append((a, "".join(b) if rand.random() < 0.7 else "".join(rand.choices(letters, k=rand.randint(0, 30)))))
    return map(list, zip(*out))


def test_ratios_equal_the_matchers():
    rand = random.Random(8)
    for letters in ("ab", "abc ", "abcdefghijklmnop  ", "é漢😀a\x00"):
        lefts, rights = names(rand, 1500, letters)
        assert ratios(lefts, rights).tolist() == plain(lefts, rights)
    hard = ["", "", "a", "", "aaaa", "abab", "qabxcd", "x" * 300, "tide", "diet"]
    other = ["", "a", "", "b", "aa", "baba", "abycdf", "x" * 300, "diet", "tide"]
    assert ratios(hard, other).tolist() == plain(hard, other)
    long = ["".join(rand.choices("abcde", k=rand.randint(150, 260))) for _ in range(30)]  # frequent characters start no block from 200 on
    assert ratios(long, long[::-1]).tolist() == plain(long, long[::-1])
    assert ratios([], []).tolist() == []


def test_pairs_together_take_less_time():
    lefts, rights = names(random.Random(1), 20_000)
    ratios(lefts[:100], rights[:100])
    began = time.process_time()
    ratios(lefts, rights)
    together = time.process_time() - began
    began = time.process_time()
    plain(lefts[:4000], rights[:4000])
    assert (time.process_time() - began) * 5 > 2 * together
