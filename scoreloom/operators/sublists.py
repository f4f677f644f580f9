"""Which lists of words are contiguous parts of which texts: sorted suffixes of the texts' words, met by prefix range."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.stored import stored

#: Ends every word of a key, so that a list is a prefix of a suffix exactly where its key is. Texts don't hold it.
END = "\x01"


def _key(words: Column) -> Column:
    return F.concat(F.array_join(words, END), F.lit(END))


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), " "), lambda w: w != "")


def sublists(lists: DataFrame, texts: DataFrame, keep=stored) -> DataFrame:
    """(phrase, text, starts): the phrases of `lists` (a column phrase) whose words follow each other somewhere in a
    text of `texts` (a column text), and the numbers of the words where they do, from 0. Words are what spaces part.

    A text has a row for each of its words: the suffix that begins there, no longer than the longest phrase, and the
    number of the text, which stands for it until all is met. Suffixes
    are sorted by range partitions; a phrase goes to those whose range its prefix range meets (their bounds are a row a
    partition), and a pass over each sorted partition keeps the phrases that the present suffix begins with. Repeated
    phrases and texts count once; null and empty ones meet nothing."""
    phrases = lists.select("phrase").distinct().withColumn("w", _words("phrase")).filter(F.size("w") > 0)
    longest = phrases.agg(F.max(F.size("w"))).first()[0] or 1
    runs = lambda w: F.transform(w, lambda _, i: F.struct(i.alias("at"), _key(F.slice(w, i + 1, F.lit(longest))).alias("key")))
    # Written whatever `keep` does: the numbers must be the same wherever they are read.
    texts = stored(texts.select("text").distinct().withColumn("of", F.monotonically_increasing_id()))
    suffixes = texts.select("of", F.explode(let(_words("text"), runs)).alias("s")).select("s.key", "of", "s.at")
    dealt = keep(suffixes.repartitionByRange("key", "of", "at").withColumn("__part", F.spark_partition_id()))
    bounds = dealt.groupBy("__part").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()  # a row a partition
    spark = lists.sparkSession
    ranges = spark.createDataFrame([tuple(b) for b in bounds], "__part int, low string, high string")
    keyed = phrases.select("phrase", _key(F.col("w")).alias("key"))
    # A prefix range begins at the key itself and ends before all that is greater without beginning with it.
    meets = (F.col("high") >= F.col("key")) & ((F.col("low") <= F.col("key")) | F.startswith("low", "key"))
    asked = keyed.join(F.broadcast(ranges), meets).select("__part", "key", F.lit(0).alias("kind"), "phrase", F.lit(None).cast("bigint").alias("of"), F.lit(-1).alias("at"))
    rows = asked.unionByName(dealt.select("__part", "key", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("phrase"), "of", "at"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_ = None, []  # keys and phrases that are prefixes of each other
        for batch in batches:
            out: list[tuple] = []
            for now, key, kind, phrase, of, at in zip(*(c.to_pylist() for c in batch.columns)):
                if now != part:
                    part, open_ = now, []
                while open_ and not key.startswith(open_[-1][0]):
                    open_.pop()
                if kind:
                    out += [(p, of, at) for _, p in open_]
                else:
                    open_.append((key, phrase))
            made = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.string(), pa.int64(), pa.int32()))], names=["phrase", "of", "at"])

    met = rows.repartition("__part").sortWithinPartitions("__part", "key", "kind").mapInArrow(merged, "phrase string, of long, at int")
    starts = met.groupBy("phrase", "of").agg(F.array_sort(F.collect_list("at")).alias("starts"))
    return starts.join(texts, "of").select("phrase", "text", "starts")
