"""Operator 12, phrase collocations by vertical positional inverted lists.

Texts are read in blocks of one language; a block holds, for each of its words, the list of the positions where it
occurs. Words of one piece have neighbouring positions, pieces lie apart. The list of a phrase is extended by merging
its positions, moved by its length, with the postings of the word that follows; what is met is the list of the longer
phrase, and its length the exact number of occurrences in the block. Only phrases that are frequent over all blocks
are extended: blocks first report the lengths by a hash of the phrase, and get back the hashes that reach the
threshold. Hashes that fall together only let more phrases be tried; counts are of whole phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_or_empty, utf8_array, utf8_buffers, written

LONGEST = 3
#: Occurrences that make a phrase a candidate, and the share of them in a longer one that drops it.
LEAST, SHARE = 10, 50
TOP = 2000
#: Words of a block; a longer text is one block by itself.
BLOCK = 1 << 20
#: Bytes of text taken apart at a time.
STEP = 1 << 22
#: How the lists are written. A row is a block, of some megabytes, and both the writer and the reader hold a whole row
#: group: its size is looked at after each row, not after a hundred as by default, whatever a task has read.
ROW_GROUPS = {"parquet.block.size": 1 << 24, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Parts of a language that are ranked apart before the last ranking.
PARTS = 64
UNKNOWN = "und"

_WORD, _SPACE, _BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[np.frombuffer(b" \t", np.uint8)] = _SPACE
KIND[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = _BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Bytes of texts and their borders -> (all words in order, their positions: one apart within a piece, two where
    a new piece or text begins)."""
    kind = KIND[data]
    inside = kind == _WORD
    text_begins = np.zeros(len(data) + 1, bool)
    text_begins[at] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[text_begins] = False  # what is before a text's first byte is no word of it
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[text_begins] = False
    stops = np.flatnonzero(inside & ~after[1:]) + 1
    borders = np.concatenate(([0], np.cumsum(stops - starts)))
    words = utf8_array(LOWER[data[inside]], borders)
    piece = np.cumsum((kind == _BREAK) | text_begins[:-1])[starts] if len(data) else starts
    new = np.ones(len(starts), np.int64)
    if len(new):
        new[0] = 0
        new[1:] += piece[1:] != piece[:-1]
    return words, np.cumsum(new)


def inverted(words: pa.Array, positions: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, lengths of their lists, the lists one after another), positions ascending in each list."""
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy()
    return coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)), positions[np.argsort(codes, kind="stable")]


def _packed(lists: np.ndarray, sizes: np.ndarray) -> bytes:
    """Lists as the gaps within them, the bytes of each significance together: what compresses well."""
    gaps = np.diff(lists, prepend=0)
    firsts = np.cumsum(sizes) - sizes
    gaps[firsts] = lists[firsts]
    return np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(packed: bytes, sizes: np.ndarray) -> np.ndarray:
    gaps = np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    sums = np.cumsum(gaps)
    firsts = np.cumsum(sizes) - sizes
    return sums - np.repeat(sums[firsts] - gaps[firsts], sizes)


def blocks(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = BLOCK) -> DataFrame:
    """(block, lang, n, words, sizes, lists): the inverted lists of each block, a row a block."""
    lang = F.coalesce(df[lang_col].cast("string"), F.lit(UNKNOWN))
    source = df.select(lang.alias("lang"), text_or_empty(df, text_col).alias("text"))
    schema = "block long, lang string, n long, words array<string>, sizes array<int>, lists binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        many: dict[str, int] = {}
        made = TaskContext.get().partitionId() << 32

        def block(of: str) -> pa.RecordBatch:
            nonlocal made
            parts, moved, at = held.pop(of), [], 0
            del many[of]
            for _, positions in parts:
                moved.append(positions + at)
                at = int(moved[-1][-1]) + 2
            known, sizes, lists = inverted(pa.concat_arrays([w for w, _ in parts]), np.concatenate(moved))
            one = pa.array([0, len(known)], pa.int32())
            columns = [pa.array([made]), pa.array([of]), pa.array([len(lists)]), pa.ListArray.from_arrays(one, known), pa.ListArray.from_arrays(one, pa.array(sizes.astype(np.int32))), pa.array([_packed(lists, sizes)])]
            made += 1
            return pa.RecordBatch.from_arrays(columns, names=["block", "lang", "n", "words", "sizes", "lists"])

        for batch in batches:
            for of in pc.unique(batch.column(0)).to_pylist():
                data, at = utf8_buffers(batch.column(1).filter(pc.equal(batch.column(0), of)))
                row = 0
                while row < len(at) - 1:
                    stop = max(row + 1, int(np.searchsorted(at, at[row] + STEP, side="right")) - 1)
                    words, positions = tokens(data[at[row] : at[stop]], at[row : stop + 1] - at[row])
                    row = stop
                    if not len(words):
                        continue
                    held.setdefault(of, []).append((words, positions))
                    many[of] = many.get(of, 0) + len(words)
                    if many[of] >= size:
                        yield block(of)
                if sum(many.values()) >= 2 * size:  # many languages at a time
                    yield from map(block, list(held))
        yield from map(block, list(held))

    return source.mapInArrow(read, schema)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Lists:
    """The inverted lists of one block, and the lists of longer phrases that grow from them."""

    def __init__(self, lang: str, words: pa.Array, sizes: np.ndarray, lists: np.ndarray):
        self.words = words
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast("binary").to_pylist()), np.uint64, len(words))
        by_position = np.argsort(lists, kind="stable")
        #: All postings by position: where, and which word.
        self.where, self.word = lists[by_position], np.repeat(np.arange(len(words)), sizes)[by_position]
        self.word_hash = hashes
        # Occurrences of the phrases of the present length, by position; phrases by their number.
        self.length, self.at, self.phrase = 1, self.where, self.word
        self.made_of, self.hashes, self.counts = np.arange(len(words))[:, None], hashes, np.asarray(sizes)

    def extend(self, known: np.ndarray | None = None) -> None:
        """Extends all phrases by the next word, and counts. known: sorted hashes of the phrases that may be extended;
        a phrase of n + 1 words is formed only where its first and its last n words both may."""
        at, phrase = self.at, self.phrase
        if known is not None:
            at, phrase = self._kept(known)
        # Merge of the positions, moved behind the phrase, with the postings.
        place = np.searchsorted(self.where, at + self.length)
        place[place == len(self.where)] = 0
        met = self.where[place] == at + self.length if len(self.where) else np.zeros(0, bool)
        if known is not None and len(at):
            follow = np.searchsorted(at, at + 1)
            follow[follow == len(at)] = 0
            met &= at[follow] == at + 1
        self.at, phrase, word = at[met], phrase[met], self.word[place[met]]
        both, first, self.phrase, self.counts = np.unique(phrase * np.int64(len(self.words)) + word, return_index=True, return_inverse=True, return_counts=True)
        self.made_of = np.concatenate((self.made_of[phrase[first]], word[first][:, None]), axis=1)
        self.hashes = _mixed(self.hashes[phrase[first]] * _ODD + self.word_hash[word[first]])
        self.length += 1

    def _kept(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stay = self.frequent(known)[self.phrase] if len(self.phrase) else np.zeros(0, bool)
        return self.at[stay], self.phrase[stay]

    def frequent(self, known: np.ndarray) -> np.ndarray:
        """Which phrases have a hash among the sorted ones given."""
        if not len(known):
            return np.zeros(len(self.hashes), bool)
        place = np.searchsorted(known, self.hashes)
        place[place == len(known)] = 0
        return known[place] == self.hashes

    def texts(self, which: np.ndarray) -> pa.Array:
        """Phrases as texts, their words joined by one space."""
        columns = [self.words.take(pa.array(self.made_of[which, k])) for k in range(self.length)]
        return pc.binary_join_element_wise(*columns, " ")


def _lists(table) -> Lists:
    """The lists of a block, given as an Arrow table or batch of one row."""
    row = {c: table.column(c)[0] for c in ("lang", "words", "sizes", "lists")}
    sizes = row["sizes"].values.to_numpy()
    return Lists(row["lang"].as_py(), row["words"].values, sizes, _unpacked(row["lists"].as_py(), sizes))


def _reached(index: DataFrame, keys: DataFrame | None, length: int, least: int) -> DataFrame:
    """(block, h): hashes of the phrases of `length` words in each block that occur at least `least` times in all."""
    schema = "h long, block long, n int"

    def report(block: int, lists: Lists, known: np.ndarray | None) -> pa.Table:
        for _ in range(length - 1):
            lists.extend(known if lists.length > 1 else None)
        columns = [pa.array(lists.hashes.view(np.int64)), pa.array(np.full(len(lists.hashes), block)), pa.array(lists.counts.astype(np.int32))]
        return pa.Table.from_arrays(columns, names=["h", "block", "n"])

    if keys is None:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    yield from report(one.column("block")[0].as_py(), _lists(one), None).to_batches()

        rows = index.mapInArrow(each, schema)
    else:

        def grown(lists: pa.Table, known: pa.Table) -> pa.Table:
            hashes = np.sort(known.column("h").to_numpy().view(np.uint64))
            return report(lists.column("block")[0].as_py(), _lists(lists), hashes) if lists.num_rows else pa.table({"h": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "n": pa.array([], pa.int32())})

        rows = index.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(grown, schema)
    # A row of each block: a sum over them says which blocks hold a frequent phrase, in one exchange.
    return rows.withColumn("f", F.sum("n").over(W.partitionBy("h"))).filter(F.col("f") >= least).select("block", "h")


def _counted(index: DataFrame, keys: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, n): occurrences in each block of the phrases of 2 words and more whose parts are in keys."""

    def count(lists: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if lists.num_rows:
            hashes = np.sort(known.column("h").to_numpy().view(np.uint64))
            lang, here = lists.column("lang")[0].as_py(), _lists(lists)
            while here.length < longest:
                here.extend(hashes if here.length > 1 else None)
                which = np.flatnonzero(here.frequent(hashes)) if here.length < longest else np.arange(len(here.hashes))
                out.append(pa.table({"lang": pa.array([lang] * len(which), pa.string()), "phrase": here.texts(which).cast("string"), "n": pa.array(here.counts[which].astype(np.int64))}))
        return pa.concat_tables(out) if out else pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

    return index.groupBy("block").cogroup(keys.groupBy("block")).applyInArrow(count, "lang string, phrase string, n long")


def _joined(words: Column, first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to `longest` words (2 or more) that keep together
    best, the first `top` of each language.

    Null languages count as one, named und; null and empty texts have no words. Rows that repeat count each. Ties go
    to the more frequent phrase, then to the smaller one by its bytes. Texts of any length are taken whole. An empty
    table gives an empty table. Frequencies up to 10^16 keep the products exact; beyond, the query fails rather than
    round."""
    index = written(blocks(df, text_col, lang_col, block), "phrase-lists", **ROW_GROUPS)
    keys = None
    for length in range(2, longest if longest > 2 else 3):
        more = _reached(index, keys, length, least)
        keys = written(more if keys is None else keys.unionByName(more), "frequent-hashes")
    words = index.select("lang", F.inline(F.arrays_zip("words", "sizes"))).select("lang", F.col("words").alias("phrase"), F.col("sizes").cast("long").alias("n"))
    counted = words.unionByName(_counted(index, keys, longest)).groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    frequent = written(counted.withColumn("words", F.split("phrase", " ")), "frequent-phrases")
    candidates = frequent.filter(F.size("words") > 1)

    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _joined(F.col("words"), F.lit(1), F.col("k")), "right": _joined(F.col("words"), F.col("k") + 1, F.size("words"))}).drop("words")
    cuts = cuts.join(frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in "alr")
    cuts = cuts.withColumns({"up": F.lit(1_000_000).cast("decimal(7,0)") * (a * a), "down": l * r}).withColumn("score", F.expr("up div down"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))

    size = F.size("words")
    within = candidates.filter(size > 2).select("lang", F.col("f").alias("longer"), "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    within = within.select("lang", "longer", "words", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at")).select("lang", "longer", _joined(F.col("words"), F.col("at"), F.col("m")).alias("phrase"))
    most = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("cut.a"))).select("lang", "phrase", "cut.*")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = index.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def oracle_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with pieces as (
    select coalesce(lang, '{UNKNOWN}') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), split as (
    select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as words from pieces
), total as (
    select lang, sum(len(words))::bigint as n from split group by lang
), places as (
    select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from split, (select unnest([{", ".join(map(str, range(1, LONGEST + 1)))}]) as k)
), frequent as (
    select lang, k, words[i:i + k - 1] as words, array_to_string(words[i:i + k - 1], ' ') as phrase, count(*) as f from places group by all having count(*) >= {LEAST}
), cuts as (
    select c.lang, c.phrase, c.k as size, j, c.f as a, x.f as l, y.f as r, (1000000::hugeint * c.f * c.f // (x.f::hugeint * y.f))::bigint as score
    from (select *, unnest(range(1, k)) as j from frequent where k > 1) c
    join frequent x on x.lang = c.lang and x.phrase = array_to_string(c.words[1:c.j], ' ')
    join frequent y on y.lang = c.lang and y.phrase = array_to_string(c.words[c.j + 1:], ' ')
), lowest as (
    select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
), within as (
    select lang, phrase, max(longer) as longer from (
        select lang, f as longer, array_to_string(words[b:b + m - 1], ' ') as phrase from (
            select *, unnest(range(1, k - m + 2)) as b from (select *, unnest(range(2, k)) as m from frequent where k > 2)))
    group by all
), ranked as (
    select lowest.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
    from lowest left join within using (lang, phrase) where longer is null or 100 * longer < {SHARE} * a
)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= {TOP}"""
