"""Operator 5, quality classifier by importance resampling.

Two bag-of-n-grams models over hashed buckets, one of the target text (documents labelled good), one of all raw
text. A document's weight is the ratio of its likelihoods; Gumbel noise on the log ratio makes the k largest keys a
sample without replacement by weight. The n-grams are words, pairs of words and triples of word shapes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, hash_sample, text_or_empty, written

#: Buckets of each of the three kinds of n-grams.
BUCKETS = 1 << 15
#: Most labelled-good documents that the target model is fitted on, taken in the order of a hash of their id.
MAX_TARGET = 20_000
#: Log weight of a document by its mean log ratio.
SHARPNESS = 20.0
#: The sample's share of the rows, unless one is given: the share of good labels among the labels, at the upper end of
#: its confidence interval of so many standard errors (Wilson).
ERRORS = 2.33
#: Words that each Python worker keeps with their hash and shape, in each of two generations.
KEPT_WORDS = 400_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> int:
    """Case, and which characters other than letters it ends with or holds: one of few numbers."""
    core = word.rstrip(".,;:")
    letters = sum(map(str.isalpha, core))
    case = 0 if core.islower() else 1 if core[:1].isupper() and (core[1:].islower() or letters == 1) else 2 if core.isupper() else 3
    other = len(core) - letters
    return case | min(other, 3) << 2 | (letters == 0) << 4 | (len(word) > len(core)) << 5


def _described(word: str) -> int:
    """48 bits of the word's hash, and its shape."""
    return (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 16) << 8 | _shape(word)


_WORDS = Memo(_described, KEPT_WORDS)


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of the n-grams of a whole text, repeats included; below 3 * buckets."""
    words = text.split()
    if not words:
        return np.empty(0, np.int64)
    both = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    h, shape = both >> np.uint64(8), both & np.uint64(255)
    again = np.zeros(len(h), np.uint64)
    again[1:] = h[1:] == h[:-1]
    shape = shape | again << np.uint64(6)
    top = np.uint64(64 - int(buckets).bit_length() + 1)
    mix = lambda x: ((x * _PRIME) >> top).astype(np.int64)
    pairs = h[:-1] * np.uint64(31) + h[1:]
    edge = np.full(1, 255, np.uint64)
    s = np.concatenate((edge, shape, edge))
    triples = (s[:-2] << np.uint64(16)) | (s[1:-1] << np.uint64(8)) | s[2:]
    return np.concatenate((mix(h), mix(pairs) + buckets, mix(triples + np.uint64(1)) + 2 * buckets))


@dataclass(frozen=True)
class ImportanceModel:
    """Log ratio of the target's and the raw text's probability, by bucket; share: of the rows that a sample takes."""

    ratios: np.ndarray
    buckets: int
    share: float

    def score(self, text: str) -> float:
        """The log weight of a whole text; 0 without words."""
        f = features(text, self.buckets)
        return SHARPNESS * float(self.ratios[f].mean()) if len(f) else 0.0


def _bucket_counts(df: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, n): of the rows' n-grams, 0 for all rows and 1 for target rows; a few rows a task leaves."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3 * buckets), np.int64)
        for b in batches:
            for t, target in zip(b.column(0), b.column(1).to_pylist()):
                f = np.bincount(features(t.as_py(), buckets), minlength=3 * buckets)
                total[0] += f
                if target:
                    total[1] += f
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[kind, at])], names=["kind", "bucket", "n"])

    return df.select("text", "target").mapInArrow(counted, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def _share(good: int, n: int) -> float:
    """The upper bound of the share of good labels; 1 without a good one, where nothing can be learnt."""
    if not good:
        return 1.0
    p, z = good / n, ERRORS * ERRORS / n
    return min(1.0, (p + z / 2 + (z * p * (1 - p) + z * z / 4) ** 0.5) / (1 + z))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS) -> ImportanceModel:
    """The ratio model: raw counts over all of docs, target counts over at most MAX_TARGET labelled-good documents.

    Only the ids of that bounded sample are broadcast; the counts come back as at most 6 * buckets rows. Without
    labelled-good documents all ratios are 0."""
    told = labels.agg(F.count_if(F.col(label_col) == 1).alias("good"), F.count(label_col).alias("n")).first()
    known = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("own"))
    good = hash_sample(known, MAX_TARGET, "importance").withColumn("good", F.lit(True))
    own = docs.select(docs[id_col].alias("own"), text_or_empty(docs, text_col).alias("text"))
    marked = own.join(F.broadcast(good), "own", "left").withColumn("target", F.col("good").isNotNull())
    counts = _bucket_counts(marked, buckets).toPandas()
    table = np.zeros((2, 3 * buckets))
    table[counts["kind"], counts["bucket"]] = counts["n"]
    ratios = np.zeros(3 * buckets)
    for k in range(3):  # each kind of n-gram is a model of its own
        part = slice(k * buckets, (k + 1) * buckets)
        raw, target = table[0, part], table[1, part]
        if raw.sum() and target.sum():
            p = (raw + 0.5) / (raw.sum() + 0.5 * buckets)
            # the target leans on the raw text where it is thin
            lean = buckets / 8
            q = (target + lean * p) / (target.sum() + lean)
            ratios[part] = np.log(q) - np.log(p)
    return ImportanceModel(ratios, buckets, _share(told["good"], told["n"]))


def keyed(docs: DataFrame, model: ImportanceModel, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """(row, score, key): a row of docs as a struct, the log weight of its whole text, and the same with Gumbel noise.

    The noise comes from a hash of id, text and seed: a task that runs again draws the same."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score).astype(float)

    text = text_or_empty(docs, text_col)
    # 52 bits of the hash give a number strictly between 0 and 1.
    bits = F.shiftrightunsigned(F.xxhash64(docs[id_col].cast("string"), text, F.lit(seed)), 12)
    noise = -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), score(text).alias("score"), noise.alias("noise"))
    return rows.select("row", "score", (F.col("score") + F.col("noise")).alias("key"))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column, exactly, with ties counted as rows; None of no values.

    Each pass cuts the range that holds it into 4096 cells and brings their counts and ends to the driver: no sort,
    no task that sees all rows. A range of equal ends is the answer; one pass more tells the last few values apart."""
    found = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if k <= 0 or not found["n"]:
        return None
    if k >= found["n"]:
        return found["lo"]
    lo, hi, above, exact = found["lo"], found["hi"], 0, False
    while lo < hi:
        inside = df.filter(F.col(column).between(lo, hi))
        cell = F.col(column) if exact else F.least(F.lit(4095.0), F.floor((F.col(column) - lo) / ((hi - lo) / 4096)).cast("double"))
        cells = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for c in sorted(cells, key=lambda c: -c["cell"]):
            if above + c["n"] >= k:
                break
            above += c["n"]
        exact = (hi - lo) / 4096 < 16 * np.spacing(max(abs(lo), abs(hi)))  # few doubles are left
        lo, hi = c["lo"], c["hi"]
    return lo


def _border(rows: DataFrame, share: float) -> float:
    """The key of the last row sampled, of rows with a key."""
    found = kth_largest(rows, "key", int(np.ceil(share * rows.count())))
    return float("inf") if found is None else found


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """(id_col, score, key, kept) for every row of docs; kept: the k rows of largest key, k = ceil(share * rows).

    share: by default that of good labels, as ERRORS says. Rows whose keys tie at the border (repeated rows) are all
    kept. A null or empty text has no n-grams: score 0. Without good labels every row is kept; of an empty table
    there is none. Texts of any length are read whole."""
    model = fit(docs, labels, id_col, text_col)
    rows = written(keyed(docs, model, id_col, text_col).select(F.col(f"row.`{id_col}`").alias(id_col), "score", "key"), "importance")
    return rows.withColumn("kept", F.col("key") >= F.lit(_border(rows, model.share if share is None else share)))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """The rows of docs that resample keeps, with docs' columns. Each text is scored once: rows are written with keys."""
    model = fit(docs, labels, id_col, text_col)
    rows = written(keyed(docs, model, id_col, text_col).select("row", "key"), "importance-rows")
    border = _border(rows.select("key"), model.share if share is None else share)
    return rows.filter(F.col("key") >= F.lit(border)).select("row.*")
