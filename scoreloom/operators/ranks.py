"""Ranks over a whole table without a task that sees all rows: range partitions, counts, and ties carried over borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import stored


def with_ranks(df: DataFrame, order: list[tuple[Column, bool]], ties: list[tuple[Column, bool]], keep=stored, rank: str = "rank", dense: str = "dense_rank", number: str = "row_number") -> DataFrame:
    """df with the rank (equal rows share the lowest), the dense rank and the number of each row in the order of `order`,
    equal rows numbered by `ties`. order and ties: values, and whether the greatest comes first (nulls are smallest).

    Rows are dealt to range partitions by order and ties together, so that very many equal rows are split too, and
    numbered in each. Of each partition its count, its first and last key and where its last key begins come to the
    driver; a key that goes on from the partition before takes its rank from there. Rows are written once, numbered."""
    keys, breaks = [f"__order{k}" for k in range(len(order))], [f"__tie{k}" for k in range(len(ties))]
    plain = df.withColumns({c: value for c, (value, _) in zip(keys + breaks, order + ties)})
    sort = [F.col(c).desc() if down else F.col(c).asc() for c, (_, down) in zip(keys + breaks, order + ties)]
    dealt = keep(plain.repartitionByRange(*sort).withColumn("__part", F.spark_partition_id()))
    whole, by_key = W.partitionBy("__part").orderBy(*sort), W.partitionBy("__part").orderBy(*sort[: len(order)])
    local = {"__n": F.row_number().over(whole).cast("bigint"), "__rank": F.rank().over(by_key).cast("bigint"), "__dense": F.dense_rank().over(by_key).cast("bigint")}
    numbered = keep(dealt.withColumns(local | {"__key": F.struct(F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys))}))
    told = numbered.groupBy("__part").agg(
        F.count("*").alias("n"), F.min_by("__key", "__n").alias("first"), F.max_by("__key", "__n").alias("last"), F.max("__rank").alias("begins"), F.max("__dense").alias("keys")
    )
    rows, before, distinct, last, began = [], 0, 0, None, 0
    for r in sorted(told.collect(), key=lambda r: r["__part"]):  # a row a partition
        goes_on = r["first"] == last
        rows.append((r["__part"], before, distinct - goes_on, began if goes_on else before + 1))
        if not (goes_on and r["keys"] == 1):
            began = before + r["begins"]
        before, distinct, last = before + r["n"], distinct - goes_on + r["keys"], r["last"]
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __before bigint, __keys bigint, __began bigint")
    out = numbered.join(F.broadcast(offsets), "__part")
    made = {
        rank: F.when(F.col("__rank") == 1, F.col("__began")).otherwise(F.col("__before") + F.col("__rank")), dense: F.col("__keys") + F.col("__dense"),
        number: F.col("__before") + F.col("__n"),
    }
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(k) for k, v in made.items()])
