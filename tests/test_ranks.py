"""Ranks without a global window, and all grains in one exchange."""

import random

from pyspark.sql import functions as F

from scoreloom import round_trips
from scoreloom.operators import ranks
from scoreloom.sources.stored import stored


def by_hand(rows):
    """rows: (value or None, tie), greatest value first and None last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out, rank, dense, last = {}, 0, 0, object()
    for n, r in enumerate(order, 1):
        if r[0] != last:
            rank, dense, last = n, dense + 1, r[0]
        out[r[1]] = (rank, dense, n)
    return out


def test_ranks_equal_counting(spark):
    rand = random.Random(3)
    for values in ([rand.randrange(5) for _ in range(300)], [7] * 200, list(range(100)), [None] * 30 + [1] * 90, [rand.choice([None, 1, 2, 2, 2]) for _ in range(150)]):
        rows = [(v, k) for k, v in enumerate(values)]
        df = spark.createDataFrame(rows, "v int, k int").withColumn("rank2", F.lit("x"))
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # all partitions, however small
        try:
            made = ranks.with_ranks(df, [(F.col("v"), True)], [(F.col("k"), False)])
            got = {r.k: (r["rank"], r["dense_rank"], r["row_number"]) for r in made.collect()}
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert got == by_hand(rows) and made.columns == ["v", "k", "rank2", "rank", "dense_rank", "row_number"]
    assert ranks.with_ranks(spark.createDataFrame([], "v int, k int"), [(F.col("v"), True)], [(F.col("k"), False)]).count() == 0


def test_no_task_sees_all_rows(spark, sf):
    steps = []

    def keep(df):
        steps.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    made = ranks.with_ranks(spark.read.parquet(f"{sf}/orders.parquet"), [(F.col("o_orderdate"), False)], [(F.col("o_orderkey"), False)], keep)
    plans = [*steps, made._jdf.queryExecution().executedPlan().toString()]
    assert "SinglePartition" not in "".join(steps) and "Window" not in plans[-1] and sum("rangepartitioning" in p for p in plans) == 1


def test_all_grains_in_one_exchange(spark, sf):
    plan = round_trips.summary_of_all_grains(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
