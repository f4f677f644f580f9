"""Operator 13, removal of long repeated strings by suffix arrays.

Every window of SPAN bytes takes as its key the smallest hash among the shorter strings in it (its anchor), so equal
windows have equal keys wherever they lie. Neighbouring windows of one anchor are one piece, at most twice as long as
a window. Pieces meet by key: a key met once has no repeat, a key whose pieces are all alike repeats in all of them.
Only keys with different pieces need their texts. Pieces of one key line up at the anchor, so they are cut there into
cells of 8 bytes; the suffix array of the cells of many pieces brings together what begins alike. It is built by
grouping suffixes by their Lyndon prefixes, from the greatest group to the smallest, and then putting each group in
order from the smallest suffix on; nothing is renamed or sorted recursively.

Where many different pieces have one key, they are cut again by longer anchors, until few are left in a group; the
last anchor is the window itself."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, text_or_empty, utf8_buffers, written

SPAN = 400
#: Lengths of the anchors, tried in this order.
ANCHORS = (128, 360, 400)
CELL = 8
#: Different pieces of one key that one suffix array takes; more are cut again by the next anchor.
GROUP = 8192
#: Pieces of small groups that one suffix array takes together.
TOGETHER = 4096
#: Bytes of text hashed at a time; longer texts are hashed in parts that overlap by a window.
STEP = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(SPAN).integers(0, 1 << 64, 256, np.uint64)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    n = 2 * STEP
    up = np.full(n, _ODD)
    down = np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each string of `length` bytes in data (2 * STEP bytes at most)."""
    if len(data) < length:
        return np.empty(0, np.uint64)
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    x = (sums[length:] - sums[:-length]) * down[: len(data) - length + 1]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    blocks = np.concatenate((x, np.full(-len(x) % width, np.uint64(2**64 - 1)))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, at: np.ndarray, anchor: int) -> tuple[np.ndarray, ...]:
    """Texts as one array of bytes and their borders -> (text, first window, windows, key, hash of the content) of every
    piece. In a piece all windows have the same last place of their least anchor, so no two of them are equal."""
    width = SPAN - anchor + 1
    hashes = string_hashes(data, anchor)
    if len(hashes) < width:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    least = _least_of(hashes, width)
    n = len(least)
    begins = np.ones(n, bool)
    begins[1:] = (least[1:] != least[:-1]) | (hashes[width : width + n - 1] == least[1:])
    text_begins = at[:-1][at[:-1] < n]
    begins[text_begins] = True
    row = np.searchsorted(at, np.arange(n), side="right") - 1 if len(at) > 2 else np.zeros(n, np.int64)
    begins &= np.arange(n) + SPAN <= at[row + 1]
    first = np.flatnonzero(begins)
    row = row[first]
    many = np.minimum(np.append(first[1:], n), at[row + 1] - SPAN + 1) - first
    content = many.astype(np.uint64)
    long = many + SPAN - 1
    for k in range(-(-2 * SPAN // anchor)):
        content = (content ^ hashes[first + np.minimum(k * anchor, long - anchor)]) * _ODD
        content ^= content >> np.uint64(31)
    return row, first - at[row], many, least[first], content


def _cut(source: DataFrame, anchor: int) -> DataFrame:
    """(a, b, start, windows, key, content) of every piece of every text of source (a, b, body)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in range(2))
            data, at = utf8_buffers(batch.column(2))
            row = 0
            while row < len(at) - 1:
                if at[row + 1] - at[row] > STEP:  # in parts that overlap, so that each window is in one of them
                    stop = row + 1
                    parts = [(k, min(at[stop], k + STEP + SPAN - 1)) for k in range(at[row], at[stop] - SPAN + 1, STEP)]
                else:
                    stop = max(row + 1, int(np.searchsorted(at, at[row] + STEP, side="right")) - 1)
                    parts = [(at[row], at[stop])]
                for begin, end in parts:
                    borders = np.clip(at[row : stop + 1], begin, end) - begin
                    text, start, many, key, content = pieces(data[begin:end], borders, anchor)
                    start += np.maximum(begin - at[row + text], 0)
                    columns = [a[row + text], b[row + text], start.astype(np.int32), many.astype(np.int32), key.view(np.int64), content.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "start", "windows", "key", "content"])
                row = stop

    return source.select("a", "b", "body").mapInArrow(cut, "a long, b long, start int, windows int, key long, content long")


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in their order; an end counts as smaller than any symbol.

    First, suffixes are grouped by their symbol. From the greatest group down, each suffix of the group is a part of
    the Lyndon prefix of the nearest earlier suffix that is in a smaller group: these move above the rest of their
    group, further up the more parts they take on. In the end a group's suffixes share their Lyndon prefix. Then, from
    the smallest suffix on, each one says which suffixes come next in their groups: those whose Lyndon prefix ends
    where it begins."""
    n = len(symbols)
    if not n:
        return []
    group_of = np.unique(np.asarray(symbols), return_inverse=True)[1]
    members = [x.tolist() for x in np.split(np.argsort(group_of, kind="stable"), np.cumsum(np.bincount(group_of))[:-1])]
    group = group_of.tolist()
    size = [len(m) for m in members]
    above, below = list(range(1, len(members) + 1)), list(range(-1, len(members) - 1))
    above[-1] = -1
    smaller = [-2] * n  # -2: not seen yet
    now, descending = len(members) - 1, []
    while now >= 0:
        if not size[now]:
            now = below[now]
            continue
        here = members[now]
        if len(here) > size[now]:
            here = [i for i in here if group[i] == now]
        descending.append(here)
        parents, last, parts = [], -1, []
        for i in here:
            p = i - 1
            while p >= 0 and smaller[p] != -2:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                if p == last:
                    parts[-1] += 1
                else:
                    parents.append(p)
                    parts.append(1)
                    last = p
        if len(parents) == 1:
            moves = (((group[last], 1), parents),) if size[group[last]] > 1 else ()
        else:
            together: dict[tuple[int, int], list[int]] = {}
            for p, k in zip(parents, parts):
                if size[group[p]] > 1:
                    together.setdefault((group[p], k), []).append(p)
            moves = sorted(together.items(), key=lambda x: -x[0][1]) if len(together) > 1 else together.items()
        for (old, _), moved in moves:
            if len(moved) == size[old]:
                continue
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = new
            if up >= 0:
                below[up] = new
            for p in moved:
                group[p] = new
        now = below[now]
    free, at = [0] * len(members), 0
    for here in reversed(descending):
        free[group[here[0]]] = at
        at += len(here)
    order, placed = [0] * n, [False] * n
    for k in range(-1, n):
        s = (order[k] if k >= 0 else n) - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = smaller[s]
    return order


def _in_common(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place, how many symbols (most at most, none of them 0) also begin elsewhere."""
    padded = np.concatenate((symbols, np.zeros(most, symbols.dtype)))
    one, two = order[:-1], order[1:]
    common, alive = np.zeros(len(one), np.int64), np.arange(len(one))
    for k in range(most):
        left = padded[one[alive] + k]
        alive = alive[(left == padded[two[alive] + k]) & (left != 0)]
        if not len(alive):
            break
        common[alive] += 1
    out = np.zeros(len(symbols), np.int64)
    out[one] = common
    out[two] = np.maximum(out[two], common)
    return out


def _equal_windows(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the windows at these places equal another one of them."""
    hashes = np.empty(len(places), np.uint64)
    for k in range(0, len(data) - SPAN + 1, STEP):  # places ascend
        mine = slice(*np.searchsorted(places, (k, k + STEP)))
        hashes[mine] = string_hashes(data[k : k + STEP + SPAN - 1], SPAN)[places[mine] - k]
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    windows, out = np.lib.stride_tricks.sliding_window_view(data, SPAN), np.zeros(len(places), bool)
    for k in range(0, len(same), 4096):
        one, two = order[same[k : k + 4096]], order[same[k : k + 4096] + 1]
        equal = (windows[places[one]] == windows[places[two]]).all(axis=1)
        out[one[equal]] = out[two[equal]] = True
    return out


def repeats_within(data: np.ndarray, at: np.ndarray, anchor: int) -> np.ndarray:
    """Different pieces (bytes and borders) of some keys -> for each window of each piece in turn, whether it equals a
    window of another one."""
    width, begin = SPAN - anchor + 1, at[:-1]
    many = np.diff(at) - SPAN + 1
    # The anchor: the last place of the least hash in the first window. Pieces are hashed in parts of STEP bytes.
    in_first = begin[:, None] + np.arange(width)
    hashes = np.empty(len(data), np.uint64)
    for k in range(0, len(data), STEP):
        part = string_hashes(data[k : k + STEP + anchor - 1], anchor)
        hashes[k : k + len(part)] = part
    firsts = hashes[in_first]
    place = width - 1 - (firsts == firsts.min(axis=1, keepdims=True))[:, ::-1].argmax(axis=1)
    head = place % CELL
    cells = (np.diff(at) - head) // CELL
    # Cells of all pieces in turn, a zero after each piece's.
    base = np.cumsum(cells + 1) - (cells + 1)
    symbols = np.zeros(int((cells + 1).sum()), np.int64)
    piece = np.repeat(np.arange(len(cells)), cells)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(cells) - cells, cells)
    bytes_at = (begin + head)[piece] + CELL * nth
    values = data[bytes_at[:, None] + np.arange(CELL)].copy().view(np.uint64).ravel()
    symbols[base[piece] + nth] = np.unique(values, return_inverse=True)[1] + 1
    common = _in_common(symbols, np.array(suffix_array(symbols.tolist())), SPAN // CELL + 1)

    piece = np.repeat(np.arange(len(many)), many)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(many) - many, many)
    cell, off = np.divmod(window - head[piece], CELL)
    aligned = off == 0
    # A window off the cells' borders holds 49 whole cells and lies in 51: repeated with all of these it is settled.
    inside = common[base[piece] + np.where(aligned, cell, cell + 1)]
    around = np.where(cell >= 0, common[base[piece] + np.maximum(cell, 0)], 0)
    full = SPAN // CELL
    out = np.where(aligned, inside >= full, around >= full + 1)
    open_ = ~aligned & (inside >= full - 1)
    if (open_ & ~out).any():  # the bytes at the two ends decide
        out[open_] |= _equal_windows(data, (begin[piece] + window)[open_])
    return out


def _runs(flags: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags of all windows of pieces in turn -> (piece, first, behind the last) of each run of set ones."""
    piece = np.repeat(np.arange(len(many)), many)
    base = np.cumsum(many) - many
    same = np.zeros(len(flags) + 1, bool)
    same[1:-1] = piece[1:] == piece[:-1]
    before, after = np.append(False, flags[:-1]) & same[:-1], np.append(flags[1:], False) & same[1:]
    first, last = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)
    return piece[first], first - base[piece[first]], last + 1 - base[piece[first]]


def _by_suffixes(groups: DataFrame, anchor: int) -> DataFrame:
    """(key, content, lo, hi): repeated windows of different pieces (key, content, body) of small groups."""
    schema = "key long, content long, lo int, hi int"

    def work(batch: pa.Table) -> pa.RecordBatch:
        key, content = (batch.column(k).to_numpy() for k in range(2))
        data, at = utf8_buffers(batch.column(2).combine_chunks())
        piece, lo, hi = _runs(repeats_within(data, at, anchor), np.diff(at) - SPAN + 1)
        return pa.RecordBatch.from_arrays([pa.array(key[piece]), pa.array(content[piece]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["key", "content", "lo", "hi"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows >= TOGETHER:
                key = held.column("key").to_numpy()
                borders = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, 0)
                borders = borders[borders > 0]
                if not len(borders):
                    break  # one group, and it may go on
                cut = borders[min(np.searchsorted(borders, TOGETHER), len(borders) - 1)]
                yield work(held.slice(0, int(cut)))
                held = held.slice(int(cut))
        if held is not None and held.num_rows:
            yield work(held)

    return groups.select("key", "content", "body").repartition("key").sortWithinPartitions("key").mapInArrow(walk, schema)


def repeated_windows(source: DataFrame, anchors: tuple[int, ...] = ANCHORS, group: int = GROUP) -> DataFrame:
    """(a, b, lo, hi): which windows of the texts of source (a, b, body) begin with a string of SPAN bytes that begins
    elsewhere in them too, as runs of places. (a, b) tells texts apart."""
    anchor, deeper = anchors[0], anchors[1:]
    cut = written(_cut(source, anchor), "pieces")
    met = cut.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("x"), F.max("content").alias("y")).filter("n > 1").select("key", (F.col("x") == F.col("y")).alias("alike"))
    met = written(met, "shared-keys")  # so that both sides of the join are dealt out by it and a key of very many pieces can be split
    shared = written(cut.join(met.hint("merge"), "key"), "shared-pieces")
    alike = shared.filter("alike").select("a", "b", F.col("start").alias("lo"), (F.col("start") + F.col("windows")).alias("hi"))
    if not deeper:
        return alike
    rest = shared.filter("not alike")
    one = rest.groupBy("key", "content").agg(F.count("*").alias("n"), F.min("windows").alias("windows"), F.min(F.struct("a", "b", "start")).alias("at"))
    one = one.select("key", "content", "n", "windows", "at.*")
    body = F.substring(F.col("body").cast("binary"), F.col("start") + 1, F.col("windows") + SPAN - 1)
    texts = written(source.join(one.hint("merge"), ["a", "b"]).select("key", "content", "n", "windows", body.alias("body")), "piece-texts")
    inner = texts.filter("n > 1").select("key", "content", F.lit(0).alias("lo"), F.col("windows").alias("hi"))
    big = written(texts.groupBy("key").count().filter(F.col("count") > group).select("key"), "big-groups")
    if big.isEmpty():
        inner = inner.unionByName(_by_suffixes(texts, anchor))
    else:
        inner = inner.unionByName(_by_suffixes(texts.join(big.hint("merge"), "key", "left_anti"), anchor))
        many = written(texts.join(big.hint("merge"), "key", "left_semi").select(F.col("key").alias("a"), F.col("content").alias("b"), "body"), "big-group-texts")
        inner = inner.unionByName(repeated_windows(many, deeper, group).withColumnsRenamed({"a": "key", "b": "content"}))
    inner = written(inner, "repeats-in-pieces")
    more = rest.join(inner.hint("merge"), ["key", "content"]).select("a", "b", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return alike.unionByName(more)


def _bucketed(texts: DataFrame) -> DataFrame:
    """texts (a, b, body) as a table of buckets of (a, b) in the shared folder: joins by them leave texts in place. Its
    name leaves the catalog when the driver ends, as its files leave the folder."""
    spark: SparkSession = texts.sparkSession
    name = f"scoreloom_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(buckets, "a", "b").sortBy("a", "b").option("path", new_path(spark, "texts")).option("compression", "zstd").format("parquet").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _left(df: DataFrame, kind: str) -> DataFrame:
    """(id, body, runs) -> (id, n_bytes, spans, kept)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, kept = [], [], []
            for body, runs in zip(batch.column(1), batch.column(2).to_pylist()):
                text = memoryview(body.as_buffer())
                gone: list[dict] = []
                for lo, hi in sorted((r["lo"], r["hi"] + SPAN - 1) for r in runs or ()):
                    if gone and lo <= gone[-1]["stop"]:
                        gone[-1]["stop"] = max(hi, gone[-1]["stop"])
                    else:
                        gone.append({"start": lo, "stop": hi})
                borders = [0, *(x for g in gone for x in (g["start"], g["stop"])), len(text)]
                n.append(len(text))
                spans.append(gone)
                kept.append(b"".join(text[i:j] for i, j in zip(borders[::2], borders[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return df.select("id", "body", "runs").mapInArrow(remove, f"id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: tuple[int, ...] = ANCHORS, group: int = GROUP) -> DataFrame:
    """(id_col, n_bytes, spans, kept) for every row of df, other columns left out.

    spans: the bytes of the text, in UTF-8, that lie in a string of SPAN bytes which also begins anywhere else in the
    table or in the text, as runs (start, stop behind the end). kept: the other bytes; a cut may part a character.
    Null and empty texts have none. Rows that repeat are repeats of one another, whatever their ids: nothing of a
    text of SPAN bytes or more is kept in either. Ids aren't looked at, so they may repeat or be null. Texts of any
    length are taken whole. An empty table gives an empty table.

    Equal texts are told by 128 bits of hash, equal pieces of one key by another 64 bits and their length."""
    body = text_or_empty(df, text_col)
    docs = df.select(df[id_col].alias("id"), body.alias("body"), F.octet_length(body).cast("long").alias("n_bytes"))
    kind = docs.schema["id"].dataType.simpleString()
    nothing, none = F.lit(b""), F.expr("cast(array() as array<struct<start: bigint, stop: bigint>>)")
    short = docs.filter(F.col("n_bytes") < SPAN).select("id", "n_bytes", none.alias("spans"), F.col("body").cast("binary").alias("kept"))

    long = docs.filter(F.col("n_bytes") >= SPAN).withColumns({"a": F.xxhash64("body"), "b": F.xxhash64("body", F.lit(SPAN))})
    texts = _bucketed(long.select("a", "b", "body").dropDuplicates(["a", "b"]))
    copies = long.groupBy("a", "b").agg((F.count("*") > 1).alias("again"))
    light = written(long.select("id", "n_bytes", "a", "b").join(copies.hint("merge"), ["a", "b"]), "texts-of-rows")
    copied = light.filter("again").select("id", "n_bytes", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"), nothing.alias("kept"))
    runs = repeated_windows(texts, anchors, group).groupBy("a", "b").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    once = light.filter("not again").select("id", "a", "b").join(texts.hint("merge"), ["a", "b"]).join(runs.hint("merge"), ["a", "b"], "left")
    return short.unionByName(copied).unionByName(_left(once, kind)).withColumnRenamed("id", id_col)
