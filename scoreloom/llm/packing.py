"""Operator 10, best-fit packing under conflicts.

Bins hold at most a capacity of words and carry a bitmap of the sources and one of the duplicate clusters in them: a
bin takes one text of a source and one of a cluster. Items go, longest first, to the tightest bin that they fit and
don't conflict with: the search starts at the first bin whose residual is large enough and goes on to the next
successor until a compatible one is found. Only if there is none a bin is opened.

Items are dealt over shards by a hash of all that packing sees of them and of a copy's number among equal ones, so that
a hot source, cluster or id is spread evenly, and every shard is packed by one task. A shard is of bounded size, whatever the table's; bins don't span shards."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_or_empty, written

CAPACITY = 2048
#: Items of a shard, about; its packing needs memory in proportion.
SHARD_ITEMS = 2048
#: Equal rows that one task makes again from their number.
COPIES = 1 << 16
WORD = SPACE.replace("[", "[^", 1)


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the order given; masks: bits of what may occur once a bin."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    carried: list[int] = []
    out = []
    for size, mask in zip(sizes, masks):
        at = bisect_left(order, (size, -1))
        while at < len(order) and carried[order[at][1]] & mask:
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
            carried[b] |= mask
        else:
            residual, b = capacity, len(carried)
            carried.append(mask)
        insort(order, (residual - size, b))
        out.append(b)
    return out


def _masks(sources: pd.Series, clusters: pd.Series) -> list[int]:
    """Source bits from 0, above them a bit for each cluster of two or more items (others can't conflict)."""
    source = pd.factorize(sources, use_na_sentinel=False)[0]
    first = int(source.max()) + 1 if len(source) else 0
    again = clusters.duplicated(keep=False)
    bit = dict(zip(clusters[again].unique(), range(first, first + len(clusters))))
    return [1 << int(s) | (1 << bit[c] if a else 0) for s, c, a in zip(source, clusters, again)]


def pack_shard(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs the items (id, source, cluster, size, piece) of one shard; adds bin, counted from 0."""
    items = items.sort_values(["size", "id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
    return items.assign(bin=best_fit(items["size"].tolist(), _masks(items["source"], items["cluster"]), capacity))


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, size_col: str | None = None,
    capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """(id_col, piece, size, shard, bin) for every piece of every row of df.

    size_col: by default the text's number of words. cluster_col: by default a hash of the whole text, so that exact
    copies never share a bin. A text of more than capacity is cut into pieces: all but the last (piece = 0, 1, ...)
    fill a bin of their own (its bin number is negative), the last is packed like other items; nothing is dropped.
    Null or empty texts are items of size 0. Null sources count as one source, null clusters as one cluster, null
    sizes as 0. bin is unique together with shard. Repeated rows are items of their own. The result depends on the rows
    alone, not on their order or partitions. An empty table packs into nothing."""
    size = F.regexp_count(text_or_empty(df, text_col), F.lit(WORD)) if size_col is None else F.coalesce(df[size_col], F.lit(0))
    cluster = F.xxhash64(text_or_empty(df, text_col)) if cluster_col is None else F.xxhash64(df[cluster_col].cast("string"))
    items = df.select(df[id_col].alias("id"), df[source_col].cast("string").alias("source"), cluster.alias("cluster"), size.cast("long").alias("words"))
    # Equal rows are counted and told apart by number: how rows lie in files plays no part, and no task sees all of them.
    alike = written(items.groupBy("id", "source", "cluster", "words").agg(F.count("*").alias("n")), "items")
    shards = max(1, -(-(alike.agg(F.sum("n")).first()[0] or 0) // shard_items))
    blocks = alike.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).repartition("id", "cluster", "block")
    last = F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1
    items = blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, last)))
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "source", "cluster", "words", "copy")]
    items = items.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int"))
    full = F.greatest(F.lit(0), F.floor((F.col("words") - 1) / capacity)).cast("int")
    items = items.withColumn("full", full)
    parts = items.select("id", "source", "cluster", (F.col("words") - F.col("full") * capacity).alias("size"), F.col("full").alias("piece"), "shard")
    # The id as a string comes back exactly; pandas would make large numbers inexact beside a null id.
    parts = parts.withColumn("name", F.col("id").cast("string"))

    def packed(shard: pd.DataFrame) -> pd.DataFrame:
        last = pack_shard(shard, capacity).reset_index(drop=True)[["name", "piece", "size", "shard", "bin"]]
        # Full pieces are counted over the shard's rows, so that repeated rows have bins of their own too.
        full = last.loc[last.index.repeat(last["piece"])]
        full = full.assign(piece=full.groupby(level=0).cumcount().astype("int32"), size=capacity, bin=range(-1, -1 - len(full), -1))
        return pd.concat([last, full]) if len(full) else last

    kind = items.schema["id"].dataType
    rows = parts.groupBy("shard").applyInPandas(packed, "name string, piece int, size long, shard int, bin long")
    return rows.select(F.col("name").cast(kind).alias(id_col), "piece", "size", "shard", "bin")
