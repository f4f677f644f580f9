"""Operator 3, language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate steps, elastic-net penalties that leave most weights at
exactly 0), calibrated by one temperature on rows that the training didn't see."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, text_or_empty, written
from .simhash import fingerprint, near_groups

UNKNOWN = "und"
#: Hash buckets of the n-grams of 1, 2 and 3 characters.
BUCKETS = 1 << 14
#: Most texts of each language that the model is fitted on, those of the smallest hash; a tenth of all sets the
#: temperature, chosen so that no near copy of theirs (fingerprints within NEAR_BITS bits) is trained on.
MAX_FIT = 1_000
NEAR_BITS = 6
#: Characters of a text looked at in one step; whatever the length, all are.
BLOCK = 1 << 16
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of the n-grams of a whole text, by bucket. Lower case; runs of other than letters become a space."""
    total = np.zeros(buckets, np.int64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    tail = np.zeros(0, np.uint64)
    for at in range(0, max(len(text), 1), BLOCK):
        block = text[at : at + BLOCK].lower()
        codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        # ASCII other than letters, and the signs from U+00A0 to U+00BF and U+2000 to U+206F, separate.
        letter = ~(((codes < 97) | ((codes > 122) & (codes < 192))) | ((codes >= 0x2000) & (codes < 0x2070)))
        codes = np.where(letter, codes, np.uint64(32))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        keep[:1] = (codes[:1] != 32) | ((tail[-1:] != 32) if len(tail) else True)
        c = np.concatenate((tail, codes[keep]))
        new = len(tail)  # n-grams that end before have been counted
        one, two, three = c * _P1, c[:-1] * _P2 + c[1:] * _P1, c[:-2] * _P1 * _P2 + c[1:-1] * _P2 + c[2:] * _P1
        parts = (one[new:], (two + np.uint64(1)) * _P2 if not new else ((two + np.uint64(1)) * _P2)[new - 1 :], (three + np.uint64(2)) * _P1 if new < 2 else ((three + np.uint64(2)) * _P1)[new - 2 :])
        for p in parts:
            total += np.bincount(((p * _P1) >> shift).astype(np.int64), minlength=buckets)
        tail = c[-2:]
    return total


def _has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # buckets + 1 rows (the last: bias), a column a language
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return _vector(counts(text, len(self.idf)), self.idf)

    def predict(self, text: str) -> tuple[str, float]:
        at, x = self.vector(text)
        z = (x @ self.weights[at] + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max())
        k = int(z.argmax())
        return self.langs[k], float(e[k] / e.sum())


def _vector(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur, and their TF-IDF values of length 1 (dampened counts)."""
    at = np.flatnonzero(c)
    return _weighed(at, c[at], idf)


def _weighed(at: np.ndarray, c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (1 + np.log(c)) * idf[at]
    return at, x / (np.sqrt(x @ x) or 1.0)


def _ftrl(rows: list, labels: np.ndarray, n_langs: int, buckets: int, order: np.ndarray) -> np.ndarray:
    """Weights by FTRL-proximal, one row at a time: the state keeps gradients' sums; weights follow from it."""
    z, n = np.zeros((buckets + 1, n_langs)), np.zeros((buckets + 1, n_langs))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for i in order:
        at, x = rows[i]
        at = np.append(at, buckets)
        x = np.append(x, 1.0)
        zs, ns = z[at], n[at]
        w = weights(zs, ns)
        score = x @ w
        p = np.exp(score - score.max())
        p /= p.sum()
        p[labels[i]] -= 1
        g = x[:, None] * p
        g2 = g * g
        z[at] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / ALPHA * w
        n[at] = ns + g2
    return weights(z, n)


def document_frequencies(df: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """In how many texts of df (column text) each bucket occurs, over all rows, and the number of rows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            for t in b.column(0):
                total += counts(t.as_py(), buckets) > 0
            n += b.num_rows
        at = np.append(np.flatnonzero(total), buckets)  # one more for the number of rows
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.append(total, n)[at])], names=["at", "n"])

    rows = df.select("text").mapInArrow(found, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets + 1, np.int64)
    out[rows["at"]] = rows["n"]
    return out[:buckets], int(out[buckets])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_fit: int = MAX_FIT, buckets: int = BUCKETS) -> LanguageModel | None:
    """A model of docs' languages, from at most max_fit texts of each language that have a letter; None without any.

    Document frequencies are those of all of docs' rows with a language and a letter."""
    text = text_or_empty(docs, text_col)
    known = docs.select(text.alias("text"), docs[lang_col].cast("string").alias("lang")).filter(F.col("lang").isNotNull() & _has_letter(F.col("text")))
    sample = written(hash_sample(known, max_fit, "language", by="lang").withColumn("h", F.xxhash64("text")).repartition(16), "language-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = zip(*((f := np.flatnonzero(c := counts(t.as_py(), buckets)), c[f]) for t in b.column(0))) if b.num_rows else ((), ())
            prints = np.fromiter((fingerprint(t.as_py()) for t in b.column(0)), np.uint64, b.num_rows)
            columns = [b.column(1), b.column(2), pa.array(prints.view(np.int64)), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "h", "print", "at", "n"])

    sample = sample.mapInArrow(counted, "lang string, h long, print long, at array<int>, n array<long>").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["h", "lang"], kind="stable", ignore_index=True)
    found, n = document_frequencies(known, buckets)
    idf = np.log((1 + n) / (1 + found)) + 1
    rows = [_weighed(np.asarray(at, np.int64), np.asarray(c), idf) for at, c in zip(sample["at"], sample["n"])]
    return model_of(rows, sample["lang"].tolist(), sample["print"].to_numpy().view(np.uint64), idf)


def model_of(rows: list, langs: list[str], prints: np.ndarray, idf: np.ndarray) -> LanguageModel:
    """The model from rows (buckets, values) and their languages."""
    names = tuple(sorted(set(langs)))
    y = np.array([names.index(x) for x in langs])
    order = np.random.default_rng(7).permutation(len(rows))
    group = near_groups(prints, NEAR_BITS)
    out = np.isin(group, group[order[: len(rows) // 10]])
    train, held = order[~out[order]], np.flatnonzero(out)
    if not len(train):  # all are near copies of one another
        train, held = order, held[:0]
    weights = _ftrl(rows, y, len(names), len(idf), np.concatenate([np.random.default_rng(k).permutation(train) for k in range(EPOCHS)]))
    scores = np.array([rows[i][1] @ weights[rows[i][0]] + weights[-1] for i in held]).reshape(len(held), len(names))
    return LanguageModel(names, idf, weights, _temperature(scores, y[held]))


def _temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the scores under which the held rows are most likely; 1 without rows.

    A row counts as its language with probability (n + 1) / (n + 2), so that rows without an error don't ask for
    boundless confidence."""
    if not len(y):
        return 1.0
    n, k = scores.shape
    target = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
    target[np.arange(n), y] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (target * z).sum(axis=1)).mean())

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def predicted(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row of df, from its whole text.

    und with score 0 where the text is null or has no letter, or the model has no language. Texts of any length are
    read whole. No shuffle; repeated rows and null ids keep their rows; an empty table stays empty."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets times languages
    text = text_or_empty(df, text_col)
    source = df.select(df[id_col].alias("id"), text.alias("text"), _has_letter(text).alias("letter"))

    def guessed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [m.predict(t.as_py()) if m and ok.as_py() else (UNKNOWN, 0.0) for t, ok in zip(b.column(1), b.column(2))]
            lang, score = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(guessed, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: Column) -> Column:
    """Rows that a model never learns from: crc32 of the id's text leaves 1 over thirds. A null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score): a model fitted on the rows not held out, applied to all."""
    model = fit(df.filter(~held_out(df[id_col])), id_col, text_col, lang_col)
    return predicted(df, model, id_col, text_col).withColumn("held_out", held_out(F.col(id_col)))
