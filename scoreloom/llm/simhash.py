"""Operator 7, SimHash near-duplicates: deletion-variant index over three segments, joined by equality and verified.

Wide fingerprints, for the pipeline's near copies, meet by whole segments (wide_buckets): where a seventh of all bits
differ, blanking each bit of longer segments takes ten times as many keys for the same pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .graph import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: 4 differing bits over 3 segments leave one segment with at most one: (first bit, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket of more distinct fingerprints than this is indexed again by its other bits.
BUCKET = 4096
#: A second-level bucket of more is compared by pairs of blocks of about so many, each pair in a task of its own.
BLOCK = 1 << 16
#: Fingerprints that one step of a bucket's comparison looks at.
STEP = 1 << 15
#: Wide fingerprints, for links beyond what 64 bits tell apart: CHECK bits are compared, WIDE of them may differ.
CHECK, WIDE = 128, 40
#: The greatest share of bits in which sets of a Jaccard similarity of 0.8 or more differ (all cases up to 90 shingles;
#: 0.1515, by the angle, for many); sets of 4 and 5 shingles differ in more of them.
APART, APART_FEW, FEW = 0.1612, 0.1875, 5
#: A pair at that limit shares no segment with this probability.
MISSED = 6e-5
#: Unlike texts that meet in a segment's bucket, on average.
MEET = 64
#: Nearest groups that a text is named in, beside the one that holds all texts it is joined to.
NEAREST = 8
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, 4096, np.uint64)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text as an unsigned integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    over = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):  # bounded memory on very long texts
        over += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * over > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own, fp): fp is the fingerprint's 64 bits as a signed long, own a hash of the text. One row per input row,
    nulls included."""
    text = text_or_empty(df, text_col)
    source = df.select(df[id_col].alias("id"), F.xxhash64(text).alias("own"), text.alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["id", "own", "fp"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(hashed, f"id {kind}, own long, fp long")


def _bits(fp: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << n) - 1))


def _variants(fp: Column, segments) -> Column:
    """Array of keys: for each segment and each of its bits, the segment with that bit blanked."""
    keys, at = [], 0
    for first, n in segments:
        for j in range(n):
            keys.append(_bits(fp, first, n).bitwiseAND(F.lit(~(1 << j))).bitwiseOR(F.lit((at + j) << 22)))
        at += n
    return F.array(*keys)


def links_within(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the distinct fingerprints of one bucket as all their pairs within radius would: a forest."""
    left, right = [], []
    rest = np.sort(fps)
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:64], front[64:]
            stay = np.ones(len(rest), bool)
            for at in range(0, len(rest), STEP):  # memory doesn't grow with the bucket
                part = rest[at : at + STEP]
                near = np.bitwise_count(part[:, None] ^ now[None, :]) <= radius
                hit = near.any(axis=1)
                if hit.any():
                    left.append(now[near[hit].argmax(axis=1)])
                    right.append(part[hit])
                    stay[at : at + STEP] = ~hit
            front = np.concatenate((front, rest[~stay]))
            rest = rest[stay]
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def near_groups(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Numbers of the components of a bounded array of fingerprints (a training sample), linked within radius bits."""
    known, where = np.unique(fps, return_inverse=True)
    left, right = links_within(known, radius)
    label = np.arange(len(known))
    # Links lead from what was found before to what was found then: a forest, so labels are passed down it in order.
    for a, b in zip(np.searchsorted(known, left).tolist(), np.searchsorted(known, right).tolist()):
        label[b] = label[a]
    return label[where]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links (u, v). Small buckets compare by offsets over whole batches, others as forests."""
    kept_k, kept_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def work(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch | None:
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.concatenate((cut, [len(k)])))
        us, vs = [], []
        small = np.repeat(sizes <= 24, sizes)
        ks, fs = k[small], f[small]
        for lag in range(1, min(24, len(ks))):
            same = ks[lag:] == ks[:-lag]
            if not same.any():
                break
            a, b = fs[:-lag][same], fs[lag:][same]
            near = (np.bitwise_count(a ^ b) <= RADIUS) & (a != b)
            us.append(a[near])
            vs.append(b[near])
        for at, n in zip(cut[sizes > 24], sizes[sizes > 24]):
            a, b = links_within(np.unique(f[at : at + n]))
            us.append(a)
            vs.append(b)
        if not us:
            return None
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"]) if len(pairs) else None

    for b in batches:
        k = np.concatenate((kept_k, b.column(0).to_numpy(zero_copy_only=False)))
        f = np.concatenate((kept_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if not len(k):
            continue
        whole = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last bucket may go on
        if whole and (out := work(k[:whole], f[:whole])) is not None:
            yield out
        kept_k, kept_f = k[whole:], f[whole:]
    if len(kept_k) and (out := work(kept_k, kept_f)) is not None:
        yield out


def _joined(index: DataFrame) -> DataFrame:
    """Meets equal keys of an index (key, fp) and keeps what verification lets through."""
    return index.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_verify, "u long, v long")


def _in_blocks(index: DataFrame, most: int) -> DataFrame:
    """index (key, fp), with keys of over `most` rows dealt out: their fingerprints lie in blocks, and every two blocks
    (and each with itself) are a key of their own, so that all pairs of a bucket still meet, in tasks of bounded size."""
    large = written(index.groupBy("key").count().filter(F.col("count") > most), "large-buckets")
    if large.isEmpty():
        return index
    many = F.ceil(F.col("count") / most)
    mine, other = F.pmod(F.xxhash64("fp"), many), F.explode(F.sequence(F.lit(0).cast("long"), many - 1))
    dealt = index.join(large.hint("merge"), "key").select("key", "fp", mine.alias("mine"), other.alias("other"))
    pairs = dealt.select("fp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"))
    return index.join(large.hint("merge"), "key", "left_anti").select("fp", "key").unionByName(pairs)


def _open(place: Column) -> Column:
    """The bits that a first-level key leaves open, by the place in it: all but its segment, and the blanked bit."""
    masks = []
    for first, n in SEGMENTS:
        closed = ((1 << n) - 1) << first
        masks += [~closed & (1 << 64) - 1 | 1 << first + j for j in range(n)]
    return F.element_at(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks]), (place + 1).cast("int"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, key, open) -> (fp, key) for each of three segments of the open bits and each bit of it: a key that holds
    the segment with this bit blanked as well."""
    for b in batches:
        for at in range(0, b.num_rows, 2048):
            part = b.slice(at, 2048)
            fp, key, free = (part.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(3))
            for mask in np.unique(free):
                mine = free == mask
                f, start = fp[mine], _mix(key[mine] * np.uint64(0x9E3779B97F4A7C15))
                bits = [i for i in range(64) if int(mask) >> i & 1]
                fps, keys = [], []
                for k in range(3):
                    segment = bits[k * len(bits) // 3 : (k + 1) * len(bits) // 3]
                    closed = sum(1 << i for i in segment)
                    for i in segment:
                        fps.append(f)
                        keys.append(_mix(start ^ _mix((f & np.uint64(closed & ~(1 << i))) + np.uint64((i + 1) << 1))))
                made = [pa.array(np.concatenate(x).view(np.int64)) for x in (fps, keys)]
                yield pa.RecordBatch.from_arrays(made, names=["fp", "key"])


def links(distinct_fps: DataFrame, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(u, v): links whose components are those of all pairs of fingerprints within RADIUS bits.

    Every such pair shares a one-wildcard variant of some segment. A bucket of over `bucket` fingerprints is not
    compared as it is: its rows are indexed again by variants of the 43 or 44 bits that its key leaves open (again a
    pair within RADIUS shares one), which deals them out over many keys. What is in one bucket then agrees in half
    of all bits or more; it is compared in memory that doesn't grow with it, dense groups in few steps (links_within),
    and over several tasks where it is larger than `block`. No pair is dropped at either level."""
    # A fingerprint becomes 64 rows: what is a small table before is dealt over as many tasks as its index needs.
    spread = distinct_fps.repartition(int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = spread.select("fp", F.explode(_variants(F.col("fp"), SEGMENTS)).alias("key"))
    hot = written(index.groupBy("key").count().filter(F.col("count") > bucket).select("key"), "hot-keys")
    if hot.isEmpty():
        return _joined(index)
    cool = _joined(index.join(hot, "key", "left_anti"))
    inside = index.join(hot, "key").withColumn("open", _open(F.shiftright(F.col("key"), 22)))
    again = written(inside.select("fp", "key", "open").mapInArrow(_again, "fp long, key long"), "second-index")
    return cool.unionByName(_joined(_in_blocks(again, block)))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(id, own, fp) of every row of df, and (fp, label) of every fingerprint: equal labels are one component.

    own is a hash of the text."""
    docs = written(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = written(docs.select("fp").distinct(), "distinct-fingerprints")
    linked = components(links(nodes, bucket))
    named = nodes.join(linked.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return docs, written(named, "labels")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of df, other columns left out.

    fingerprint: 16 hex digits, zero for a text that is null, empty or without words. component_id: the smallest
    id reachable by links of at most RADIUS bits, itself included; a null id counts as no id (component_id is null
    only where no row of the component has one). Repeated rows are kept. An empty table gives an empty table."""
    docs, named = groups(df, id_col, text_col, bucket)
    smallest = docs.groupBy("fp").agg(F.min("id").alias("first")).join(named, "fp").groupBy("label").agg(F.min("first").alias("component_id"))
    # Written, so that both sides of the join below are dealt out by it and Spark can split a component of very many.
    smallest = written(smallest, "components")
    by_fp = written(named.join(smallest, "label").select("fp", "component_id"), "fingerprint-components")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return docs.join(by_fp, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near=groups) -> DataFrame:
    """One row of each component of df, with df's columns; near finds the components.

    The row that stays is the one of the smallest id (null ids last), of equal ids the one whose text has the
    smallest hash, of equal texts the one whose whole row has; of rows equal in every column one stays. So rows that
    share an id but not a text are judged apart: each stays or goes with its own component."""
    docs, named = near(df, id_col, text_col)
    node = next(c for c in docs.columns if c not in ("id", "own"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "own")
    first = docs.groupBy(node).agg(F.min(order).alias("first")).join(named.hint("merge"), node).groupBy("label").agg(F.min("first").alias("first"))
    stay = written(first.select(F.col("first.id").alias("__stay_id"), F.col("first.own").alias("__stay_own")), "kept-rows")
    # They grow with the table: a sort-merge join at every size, never a broadcast of them.
    own = F.xxhash64(text_or_empty(df, text_col))
    out = df.join(stay.hint("merge"), df[id_col].eqNullSafe(F.col("__stay_id")) & (own == F.col("__stay_own")), "left_semi")
    again = docs.groupBy("id", "own").count().filter("count > 1")
    again = written(again.join(stay, F.col("id").eqNullSafe(F.col("__stay_id")) & (F.col("own") == F.col("__stay_own")), "left_semi"), "repeated-rows")
    if again.isEmpty():
        return out
    # Rows of repeated (id, text): one of each by the whole row's hash; all others go by untouched.
    many = again.select(F.col("id").alias("__stay_id"), F.col("own").alias("__stay_own"))
    same = df[id_col].eqNullSafe(F.col("__stay_id")) & (own == F.col("__stay_own"))
    once = out.join(many.hint("merge"), same, "left_anti")
    rest = out.join(many.hint("merge"), same, "left_semi").withColumns({"__stay_own": own, "__stay_row": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])})
    least = rest.groupBy(F.col(id_col).alias("__stay_id"), "__stay_own").agg(F.min("__stay_row").alias("__stay_row"))
    least = written(least, "least-rows")
    rest = rest.join(least.select(F.col("__stay_row").alias("__row")).distinct().hint("merge"), F.col("__stay_row") == F.col("__row"), "left_semi")
    return once.unionByName(rest.dropDuplicates(["__stay_row"]).select(df.columns))


def segments_for(rows: int) -> tuple[int, int, int]:
    """Bits of a segment of wide fingerprints, how many segments a text has, and how many one of FEW shingles or less.

    Segments are longer where more texts would meet in a bucket by chance, and more of them are needed then."""
    width = 14
    while rows > MEET << width:
        width += 2
    many, few = (math.ceil(math.log(MISSED) / math.log1p(-((1 - p) ** width))) for p in (APART, APART_FEW))
    return width, many, few


def wide_bits(hashes: np.ndarray, n: int) -> np.ndarray:
    """The first n bits of the SimHash of a set of hashes; each 64 bits come from hashes mixed with a salt of their own."""
    salts = _SALTS[: -(-n // 64)]
    over = np.zeros(64 * len(salts), np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        x = hashes[at : at + 255, None] ^ salts
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
        over += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (2 * over > len(hashes))[:n]


def wide_fingerprint(hashes: np.ndarray, width: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """CHECK bits of a set, as two longs, and its segments, as whole numbers."""
    bits = wide_bits(hashes, CHECK + width * segments)
    return np.packbits(bits[:CHECK]).view(np.int64), bits[CHECK:].reshape(segments, width) @ (1 << np.arange(width))


def _wide_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first row of each row's component in one bucket of CHECK bits (a, b), in memory that doesn't grow with it."""
    first, rest = np.arange(len(a)), np.arange(len(a))
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:64], front[64:]
            stay = np.ones(len(rest), bool)
            for at in range(0, len(rest), STEP):
                part = rest[at : at + STEP]
                hit = (np.bitwise_count(a[part][:, None] ^ a[now]) + np.bitwise_count(b[part][:, None] ^ b[now]) <= WIDE).any(axis=1)
                first[part[hit]] = root
                stay[at : at + STEP] = ~hit
            front = np.concatenate((front, rest[~stay]))
            rest = rest[stay]
    return first


def _wide_verify(batches: Iterator[pa.RecordBatch], apart: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, a, b) sorted by key -> (node, root) for each text with another within WIDE bits in its bucket;
    root is the smallest node of those that such steps lead to there. apart: a third column, the bits in which these two
    differ."""

    def work(k: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.append(cut, len(k)))
        first = np.arange(len(k))
        us, vs, left = [], [], np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 128), sizes))
        for lag in range(1, 128):
            left = left[left + lag < len(k)]
            left = left[k[left + lag] == k[left]]
            if not len(left):
                break
            far = np.bitwise_count(a[left] ^ a[left + lag]) + np.bitwise_count(b[left] ^ b[left + lag])
            us.append(left[far <= WIDE])
            vs.append(us[-1] + lag)
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            while (first[u] != first[v]).any():
                low = np.minimum(first[u], first[v])
                np.minimum.at(first, u, low)
                np.minimum.at(first, v, low)
        for at, n in zip(cut[sizes > 128], sizes[sizes > 128]):
            first[at : at + n] = at + _wide_parts(a[at : at + n], b[at : at + n])
        order = np.lexsort((node, first))
        heads = np.flatnonzero(np.diff(first[order], prepend=-1))
        root = np.empty(len(k), np.int64)
        root[order] = np.repeat(order[heads], np.diff(np.append(heads, len(k))))
        near = np.bincount(first, minlength=len(k))[first] > 1
        mine, root = np.flatnonzero(near), root[near]
        columns = [node[mine], node[root]]
        if apart:
            columns.append((np.bitwise_count(a[mine] ^ a[root]) + np.bitwise_count(b[mine] ^ b[root])).astype(np.int64))
        pairs = np.unique(np.stack(columns, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs.T], names=["node", "root", "apart"][: len(columns)])

    held = [np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)]
    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        held = [np.concatenate((x, y.view(x.dtype))) for x, y in zip(held, new)]
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last bucket may go on
        if whole:
            yield work(*(x[:whole] for x in held))
            held = [x[whole:] for x in held]
    if len(held[0]):
        yield work(*held)


def _wide_blocks(index: DataFrame, most: int) -> DataFrame:
    """index (key, node, a, b), with the buckets of over `most` texts dealt out by pairs of blocks, as in _in_blocks.
    Which ones are is told from every 64th text: it is no matter of the result, since all pairs meet either way."""
    seen = index.filter(F.pmod(F.xxhash64("node"), F.lit(64)) == 0).groupBy("key").count()
    large = written(seen.filter(F.col("count") * 64 > most).select("key", (F.col("count") * 64).alias("count")), "large-buckets")
    if large.isEmpty():
        return index
    many = F.ceil(F.col("count") / most)
    mine, other = F.pmod(F.xxhash64("node"), many), F.explode(F.sequence(F.lit(0).cast("long"), many - 1))
    dealt = index.join(large.hint("merge"), "key").select("key", "node", "a", "b", mine.alias("mine"), other.alias("other"))
    pairs = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node", "a", "b")
    return index.join(large.select("key").hint("merge"), "key", "left_anti").unionByName(pairs)


def _few_groups(met: DataFrame) -> DataFrame:
    """met (node, root, apart), repeats allowed -> (node, root): at most NEAREST + 2 rows a text, written.

    A text of a large group meets others in most of its segments, and nearly every time under another root. So the
    groups that meet in texts are joined (components), and a text is named in the whole that this gives: any two that
    were in a group together are. Beside that it is named with the roots nearest to it, which it is likeliest to be a
    copy of, and under itself where it is a root."""
    held = met.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("apart", "root"))).alias("near"))
    held = written(held.select("node", F.transform("near", lambda x: x["root"]).alias("roots")), "near-fingerprints")
    low = F.array_min("roots").alias("v")
    wholes = components(held.select(F.col("node").alias("u"), low).unionByName(held.select(F.explode("roots").alias("u"), low).distinct()))
    others, own = F.filter("roots", lambda r: r != F.col("node")), F.filter("roots", lambda r: r == F.col("node"))
    named = held.join(wholes.hint("merge"), "node").select("node", F.explode(F.array_distinct(F.concat(F.slice(others, 1, NEAREST), own, F.array("label")))).alias("root"))
    return written(named, "near-groups")


def wide_buckets(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """texts (node, a, b, segments) -> (node, root), written: groups of texts, a few for each text.

    Texts that agree in a segment meet by its key; those whose CHECK bits lie within WIDE of one another, or are joined
    by such steps in the bucket, are one group. Any two within WIDE that share a segment are in a group together."""
    keyed = texts.select("node", "a", "b", F.posexplode("segments").alias("nth", "bits"))
    index = keyed.select((F.shiftleft(F.col("nth").cast("long"), 32) + F.col("bits")).alias("key"), "node", "a", "b")
    met = _wide_blocks(index, block).select("key", "node", "a", "b").repartition("key").sortWithinPartitions("key")
    return _few_groups(met.mapInArrow(partial(_wide_verify, apart=True), "node long, root long, apart long"))
