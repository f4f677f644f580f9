"""Similarity of names: the ratio of matching blocks, which Spark SQL lacks, for arrays of pairs in Arrow batches.

The longest common block of every pair is found by one table row at a time for all pairs together; what lies left and
right of it are pairs of the next round. Blocks are those that a pass from left to right finds first."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs compared together, and the cells of their tables.
TOGETHER, CELLS = 1 << 13, 1 << 19
#: From this length on, frequent characters of the right text start no block; such pairs go one by one.
LONG = 200


def _coded(lefts: list[str], rights: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts as small numbers from 2, and where each text begins; behind the last one place more."""
    data = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (lefts, rights)]
    known, codes = np.unique(np.concatenate(data), return_inverse=True)
    codes = (codes + 2).astype(np.uint8 if len(known) < 254 else np.uint32)
    starts = [np.concatenate(([0], np.cumsum([len(t) for t in x], dtype=np.int64))) for x in (lefts, rights)]
    end = np.zeros(1, codes.dtype)
    return np.append(codes[: len(data[0])], end), starts[0], np.append(codes[len(data[0]) :], end), starts[1]


def _longest(a: np.ndarray, b: np.ndarray, alo: np.ndarray, an: np.ndarray, blo: np.ndarray, bn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of pieces (first place and length in a and in b) the longest common block: size, place in the piece
    of a, place in the piece of b; of equal ones the first in a, then in b. A pair is a column of the table."""
    n, width, height = len(alo), int(bn.max()), int(an.max())
    rows, steps = np.arange(width)[:, None], np.arange(height)[:, None]
    right = np.where(rows < bn, b[np.minimum(blo + rows, len(b) - 1)], 0).astype(b.dtype)
    left = np.where(steps < an, a[np.minimum(alo + steps, len(a) - 1)], 1).astype(a.dtype)
    run, now = np.zeros((2, width + 1, n), np.uint8)
    size, at, to = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    equal = np.empty((width, n), bool)
    for i in range(height):
        np.equal(right, left[i], out=equal)
        np.add(run[:-1], 1, out=now[1:])
        np.multiply(now[1:], equal, out=now[1:])
        run, now = now, run
        longest = run.max(axis=0)
        better = np.flatnonzero(longest > size)
        if len(better):
            size[better] = longest[better]
            at[better] = i + 1 - size[better].astype(np.int64)
            to[better] = run[:, better].argmax(axis=0) - size[better].astype(np.int64)
    return size.astype(np.int64), at, to


def matching(lefts: list[str], rights: list[str]) -> np.ndarray:
    """How many characters lie in matching blocks, for each pair of texts shorter than LONG on the right."""
    a, a_at, b, b_at = _coded(lefts, rights)
    out = np.zeros(len(lefts), np.int64)
    pair = np.arange(len(lefts))
    alo, an, blo, bn = a_at[:-1], np.diff(a_at), b_at[:-1], np.diff(b_at)
    while len(pair):
        order = np.lexsort((an, bn))  # pieces of like lengths together
        pair, alo, an, blo, bn = (x[order] for x in (pair, alo, an, blo, bn))
        some = (an > 0) & (bn > 0)
        pair, alo, an, blo, bn = (x[some] for x in (pair, alo, an, blo, bn))
        more, k = [], 0
        while k < len(pair):
            stop = min(len(pair), k + TOGETHER)
            stop = min(stop, k + max(1, CELLS // int(bn[stop - 1] + 1)))
            s = slice(k, stop)
            size, at, to = _longest(a, b, alo[s], an[s], blo[s], bn[s])
            np.add.at(out, pair[s], size)
            hit = size > 0
            p, x, y, m = pair[s][hit], at[hit], to[hit], size[hit]
            more.append((p, alo[s][hit], x, blo[s][hit], y))
            more.append((p, alo[s][hit] + x + m, an[s][hit] - x - m, blo[s][hit] + y + m, bn[s][hit] - y - m))
            k = stop
        pair, alo, an, blo, bn = (np.concatenate(x) for x in zip(*more)) if more else (pair[:0],) * 5
    return out


def ratios(lefts: list[str], rights: list[str]) -> np.ndarray:
    """The ratio of each pair: twice the matching characters to all characters; 1 of two empty texts."""
    out, short = np.ones(len(lefts)), [k for k, b in enumerate(rights) if len(b) < LONG]
    some_a, some_b = [lefts[k] for k in short], [rights[k] for k in short]
    total = np.array([len(x) + len(y) for x, y in zip(some_a, some_b)], float)
    out[short] = np.where(total > 0, 2.0 * matching(some_a, some_b) / np.maximum(total, 1), 1.0)
    for k in set(range(len(lefts))).difference(short):
        out[k] = SequenceMatcher(None, lefts[k], rights[k]).ratio()
    return out


@F.pandas_udf(T.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of left against right (not symmetric); null if either is."""
    known = left.notna() & right.notna()
    out = pd.Series(np.nan, index=left.index, dtype="Float64")
    out[:] = pd.NA
    out[known] = ratios(left[known].tolist(), right[known].tolist())
    return out


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("at", T.IntegerType())]))
def best_of(names: pd.Series, others: pd.Series) -> pd.DataFrame:
    """Highest ratio of a name against an array of others and the first place where it is reached; at is null if all
    are 0."""
    scores, places = np.zeros(len(names)), [None] * len(names)
    many = [list(o) for o in others]
    k = 0
    while k < len(many):  # a bounded number of pairs at a time
        stop, pairs = k, 0
        while stop < len(many) and (stop == k or pairs + len(many[stop]) <= 1 << 16):
            pairs += len(many[stop])
            stop += 1
        lefts = [name for name, o in zip(names[k:stop], many[k:stop]) for _ in o]
        found = ratios(lefts, [x for o in many[k:stop] for x in o])
        at = 0
        for row in range(k, stop):
            mine = found[at : at + len(many[row])]
            at += len(many[row])
            if len(mine) and mine.max() > 0:
                places[row] = int(mine.argmax())
                scores[row] = mine[places[row]]
        k = stop
    return pd.DataFrame({"score": scores, "at": pd.array(places, "Int32")})
