"""Operator 2, toxicity by a classifier chain.

Categories are predicted one after the other. The linear model of a category sees a text's words and the
probabilities of all earlier categories. In training those are out-of-fold predictions, so that a later model meets
the same kind of error in training as in use. Copies and near copies of a text are always in one fold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, hash_sample, text_or_empty, written
from .simhash import fingerprint, near_groups

#: Most labelled rows of each combination of categories that the chain is fitted on; they count for all of theirs.
MAX_FIT = 2_000
FOLDS = 4
#: Texts whose fingerprints differ in no more bits than this are near copies, as far as folds go.
NEAR_BITS = 6
#: Places of the table that words and beginnings of words are hashed into: fixed, whatever words the texts have.
PLACES = 1 << 24
PREFIXES = (5, 7)
#: A model's own weights: those of features whose log-likelihood ratio (G squared) against its category is at least this.
TELLING = 16.0
ROUNDS, STEP, PENALTY = 150, 0.4, 1e-4
#: Words that each Python worker keeps with their features, in each of two generations.
KEPT_WORDS = 400_000
EDGES = ".,;:!?\"'()[]{}*&%#$|<>…«»“”-"

#: The chain's categories from the columns of labels, in order: name, SQL. The tables at hand tell of quality and
#: toxicity only; with labels of kinds of toxicity (insult, threat, ...) these are the categories to name here.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def features_of(word: str) -> tuple[str, ...]:
    """A word in lower case without the signs at its ends, and its beginnings (marked by a final *)."""
    w = word.lower().strip(EDGES)
    return (w, *(w[:n] + "*" for n in PREFIXES if len(w) >= n)) if w else ()


def features(text: str) -> set[str]:
    """The distinct features of a whole text."""
    return {f for w in set(text.split()) for f in features_of(w)}


def place_of(feature: str) -> int:
    """The place of a feature in the table."""
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass")) % PLACES


@dataclass(frozen=True)
class Chain:
    """names: the categories; words: number of each place of the table that has a weight; weights: a row a category, over features, earlier categories
    and bias; thresholds: probabilities from which a text belongs to a category."""

    names: tuple[str, ...]
    words: dict[str, int]
    weights: np.ndarray
    thresholds: tuple[float, ...]

    def numbers(self, word: str) -> tuple[int, ...]:
        places = map(place_of, features_of(word))
        return tuple(self.words[p] for p in places if p in self.words)

    def predict(self, text: str, numbers=None) -> list[float]:
        """Probabilities of the categories; numbers: a store of self.numbers."""
        found = numbers.__getitem__ if numbers is not None else self.numbers
        at = list({n for ns in map(found, set(text.split())) if ns for n in ns})  # a feature counts once
        scores = self.weights[:, at].sum(axis=1)
        n, out = len(self.words), []
        for k in range(len(self.names)):
            z = scores[k] + self.weights[k, -1] + sum(self.weights[k, n + j] * (p - 0.5) for j, p in enumerate(out))
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


def _telling(rows: list[np.ndarray], y: np.ndarray, n_words: int) -> np.ndarray:
    """Which features tell texts of the category from others: by the log-likelihood ratio of their 2 by 2 table."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.concatenate(rows) if lengths.sum() else np.empty(0, np.int64)
    with_f = np.bincount(at, minlength=n_words).astype(float)
    both = np.bincount(at, weights=np.repeat(y, lengths), minlength=n_words)
    n, pos = len(y), y.sum()
    g = np.zeros(n_words)
    for seen, expected in ((both, with_f * pos / n), (with_f - both, with_f * (n - pos) / n), (pos - both, (n - with_f) * pos / n), (n - pos - with_f + both, (n - with_f) * (n - pos) / n)):
        g += 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))
    return g >= TELLING


def _train(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, n_words: int, counts: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge penalty by full-gradient steps of adaptive length (one a weight).

    counts: how many rows each row stands for."""
    width = n_words + extra.shape[1] + 1
    w, seen = np.zeros(width), np.full(width, 1e-8)
    if not len(y) or y.min() == y.max():
        w[-1] = 0.0 if not len(y) else 6.0 if y[0] else -6.0
        return w
    used = _telling(rows, y, n_words)
    rows = [r[used[r]] for r in rows]
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.concatenate(rows) if lengths.sum() else np.empty(0, np.int64)
    of = np.repeat(np.arange(len(rows)), lengths)
    part = counts / counts.sum()
    mean = part @ y
    w[-1] = np.log(mean / (1 - mean))
    for _ in range(ROUNDS):
        z = np.bincount(of, weights=w[at], minlength=len(rows)) + extra @ w[n_words:-1] + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * part
        g = np.concatenate((np.bincount(at, weights=error[of], minlength=n_words), error @ extra, [error.sum()]))
        g[:-1] += PENALTY * w[:-1]
        seen += g * g
        w -= STEP * g / np.sqrt(seen)
    return w


def _probability(w: np.ndarray, rows: list[np.ndarray], extra: np.ndarray, n_words: int) -> np.ndarray:
    z = np.array([w[r].sum() for r in rows]) + extra @ w[n_words:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def folds_of(hashes: np.ndarray, fingerprints: np.ndarray, folds: int) -> np.ndarray:
    """The fold of each text: near copies form groups, and groups are dealt in the order of their smallest hash."""
    group = near_groups(fingerprints, NEAR_BITS)
    first: dict[int, int] = {}
    for g, h in zip(group.tolist(), hashes.tolist()):
        first[g] = min(h, first.get(g, h))
    place = {g: k for k, g in enumerate(sorted(first, key=first.get))}
    return np.array([place[g] % folds for g in group.tolist()], np.int64)


def chain_of(names: tuple[str, ...], words: list[int], rows: list[np.ndarray], ys: np.ndarray, fold: np.ndarray, counts: np.ndarray) -> Chain:
    """The chain from rows of numbers of words (the table's places in use); ys: a column a category."""
    n_words, last = len(words), ys.shape[1] - 1
    extra, weights, thresholds = np.zeros((len(rows), 0)), [], []
    for k in range(ys.shape[1]):
        y = ys[:, k]
        held = np.zeros(len(rows))
        for f in np.unique(fold):
            fit_on, out = fold != f, fold == f
            w = _train([r for r, m in zip(rows, fit_on) if m], extra[fit_on], y[fit_on], n_words, counts[fit_on])
            held[out] = _probability(w, [r for r, m in zip(rows, out) if m], extra[out], n_words)
        w = _train(rows, extra, y, n_words, counts)
        weights.append(np.concatenate((w[:n_words], w[n_words:-1], np.zeros(ys.shape[1] - k), w[-1:])))
        thresholds.append(_threshold(held, y, counts))
        if k < last:
            extra = np.column_stack((extra, held - 0.5))
    table = np.array(weights)
    used = np.flatnonzero(table[:, :n_words].any(axis=0))  # what no model uses isn't sent to the executors
    table = np.concatenate((table[:, used], table[:, n_words:]), axis=1)
    return Chain(names, {words[k]: i for i, k in enumerate(used)}, table, tuple(thresholds))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories=CATEGORIES, max_fit: int = MAX_FIT, folds: int = FOLDS) -> Chain:
    """The chain, fitted on labelled rows, at most max_fit of each combination of categories; a row stands for as many
    as its combination has. Where labels of one id differ, a category holds if any says so. Only the rows' ids are
    broadcast. Texts that are equal, with equal labels, count once."""
    names = tuple(name for name, _ in categories)
    ys = [f"y{k}" for k in range(len(names))]
    told = labels.select(F.col(id_col).alias("own"), *[F.coalesce(F.expr(sql), F.lit(False)).cast("int").alias(y) for y, (_, sql) in zip(ys, categories)])
    told = told.filter("own is not null").groupBy("own").agg(*[F.max(y).alias(y) for y in ys]).withColumn("kind", F.concat_ws("", *ys))
    known = {r["kind"]: r["count"] for r in told.groupBy("kind").count().collect()}  # a row a combination
    told = hash_sample(told, max_fit, "toxicity", by="kind")
    text = docs.select(F.col(id_col).alias("own"), text_or_empty(docs, text_col).alias("text"))
    # A repeated id may have many texts: drawn once more, so that the bound holds for texts too.
    marked = text.join(F.broadcast(told), "own").select("text", *ys, "kind")
    chosen = hash_sample(marked, max_fit, "toxicity", by="kind").select("text", F.xxhash64("text").alias("h"), *ys, "kind")
    chosen = written(chosen.repartition(16), "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [sorted(set(map(place_of, features(t.as_py())))) for t in b.column(0)]
            prints = np.fromiter((fingerprint(t.as_py()) for t in b.column(0)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), pa.array(prints.view(np.int64)), *b.columns[1:]], names=["at", "print", *b.schema.names[1:]])

    # Places come to the driver, at most max_fit lists of each combination; words stay where they are.
    sample = chosen.mapInArrow(counted, "at array<int>, print long, h long, " + ", ".join(f"{y} int" for y in ys) + ", kind string").toPandas()
    sample = sample.sort_values(["h", *ys], kind="stable", ignore_index=True)
    used = np.unique(np.concatenate([np.asarray(at, np.int64) for at in sample["at"]])) if len(sample) else np.empty(0, np.int64)
    rows = [np.searchsorted(used, np.asarray(at, np.int64)) for at in sample["at"]]
    fold = folds_of(sample["h"].to_numpy(), sample["print"].to_numpy().view(np.uint64), folds) if len(rows) else np.empty(0, np.int64)
    drawn = sample["kind"].value_counts()
    counts = np.array([known[k] / drawn[k] for k in sample["kind"]], float)
    return chain_of(names, used.tolist(), rows, sample[ys].to_numpy(float).reshape(len(rows), len(ys)), fold, counts)


def _threshold(p: np.ndarray, y: np.ndarray, counts: np.ndarray) -> float:
    """The probability from which out-of-fold predictions have the best F1; 0.5 if nothing is to be found."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    part = counts[order]
    hits = np.cumsum(y[order] * part)
    f1 = 2 * hits / (np.cumsum(part) + hits[-1])
    k = int(f1.argmax())
    return float((p[order[k]] + p[order[min(k + 1, len(y) - 1)]]) / 2)


def predicted(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, p_<category>, is_<category>, ...) for every row of df, from its whole text.

    A null or empty text has the probabilities of a text without known words; texts of any length are read whole. No
    shuffle; repeated rows and null ids keep their rows; an empty table stays empty."""
    shared = df.sparkSession.sparkContext.broadcast(chain)  # at most PLACES places, those of the sample's words that tell
    source = df.select(df[id_col].alias("id"), text_or_empty(df, text_col).alias("text"))
    names = [f"p_{n}" for n in chain.names]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        store = Memo(chain.numbers, KEPT_WORDS)
        for b in batches:
            p = np.array([chain.predict(t.as_py(), store) for t in b.column(1)]).reshape(b.num_rows, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(len(names)))], names=["id", *names])

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(scored, f"id {kind}, " + ", ".join(f"{n} double" for n in names))
    flags: dict[str, Column] = {f"is_{n}": F.col(f"p_{n}") >= F.lit(t) for n, t in zip(chain.names, chain.thresholds)}
    return out.withColumns(flags).withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A chain fitted on the labelled rows of docs, applied to all of docs. Without labels nothing is found toxic."""
    return predicted(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
