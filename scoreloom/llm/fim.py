"""Operator 11, fill-in-middle: one numpy kernel over the Arrow buffers of a whole batch cuts and rearranges all rows
together.

A table of byte classes says of each byte whether it breaks a line, begins a character or belongs to a mark. A unit
begins where the byte before it is a break, or where a text begins; running sums of these beginnings, taken from the
sum at the text's first byte, number the units of every text, and one searchsorted over them finds the cuts of all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, utf8_array, utf8_buffers

SEED = 7
#: Of 100 texts, how many are rearranged, and how many of these have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
MARKS = b"<P><S><M>"
FORMS = np.array(["plain", "psm", "spm"])
#: Bytes of text that one call of the kernel takes (a longer text is taken alone).
STEP = 1 << 22

_BREAK, _CHARACTER, _OPEN, _LETTER, _CLOSE = 1, 2, 4, 8, 16
KIND = np.zeros(256, np.uint8)
KIND[:0x80] |= _CHARACTER
KIND[0xC0:] |= _CHARACTER
KIND[ord("\n")] |= _BREAK
KIND[ord("<")] |= _OPEN
KIND[ord(">")] |= _CLOSE
KIND[np.frombuffer(b"PSM", np.uint8)] |= _LETTER


def _running(flags: np.ndarray) -> np.ndarray:
    """Flags before each place, the end included."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def rearranged(data: np.ndarray, at: np.ndarray, draws: np.ndarray, rate: int = RATE, suffix_first: int = SUFFIX_FIRST):
    """Texts as one array of UTF-8 bytes and their borders in it, and four draws a text (4 x texts) ->
    (units, forms as places in FORMS, characters before the middle, of the middle, bytes put out, their borders)."""
    begin, end = at[:-1], at[1:]
    kind = KIND[data]
    first = np.zeros(len(data), bool)
    first[1:] = kind[:-1] & _BREAK != 0
    first[begin[begin < end]] = True
    before = _running(first)
    n = before[end] - before[begin]
    cuts = np.sort(draws[:2] % (n + 1), axis=0)
    # The place of unit k of a text is where the running sum first exceeds the text's own sum by k.
    one, two = np.minimum(np.searchsorted(before, before[begin] + cuts + 1) - 1, end)

    opens = np.flatnonzero((kind[:-2] & _OPEN != 0) & (kind[1:-1] & _LETTER != 0) & (kind[2:] & _CLOSE != 0))
    holder = np.searchsorted(at, opens, side="right") - 1
    marked = np.zeros(len(n), bool)
    marked[holder[opens + 3 <= end[holder]]] = True
    plain = (begin == end) | marked | (draws[2] % 100 >= rate)
    form = np.where(plain, 0, np.where(draws[3] % 100 < suffix_first, 2, 1))

    characters = _running(kind & _CHARACTER != 0)
    ahead, inside = characters[one] - characters[begin], characters[two] - characters[one]

    # Six parts a row: (mark, text) three times; a plain row is one part, the other five are empty.
    prefix, suffix, middle = (begin, one), (two, end), (one, two)
    mark = [(np.full_like(begin, len(data) + k), np.full_like(begin, len(data) + k + 3)) for k in (0, 3, 6)]
    psm = (mark[0], prefix, mark[1], suffix, mark[2], middle)
    spm = (mark[1], suffix, mark[0], prefix, mark[2], middle)
    whole = (begin, end)
    none = (begin, begin)
    parts = [[np.choose(form, choice) for choice in zip(a, b, c)] for a, b, c in zip((whole, *[none] * 5), psm, spm)]
    start = np.stack([p[0] for p in parts], axis=1).ravel()
    length = np.stack([p[1] for p in parts], axis=1).ravel() - start
    stops = np.cumsum(length)
    total = int(stops[-1]) if len(stops) else 0
    narrow = np.int32 if max(total, len(data) + len(MARKS)) < 1 << 31 else np.int64
    source = np.concatenate((data, np.frombuffer(MARKS, np.uint8)))
    take = np.repeat((start - (stops - length)).astype(narrow), length)
    take += np.arange(total, dtype=narrow)
    return n, form, ahead, inside, source[take], np.concatenate(([0], stops[5::6]))


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) for every row of df, other columns left out.

    A text is cut into n lines and two of their borders are drawn by a hash of seed and id, so a row's result depends
    on nothing but the row. A null or empty text is plain (n is 0), and so is one that holds a mark; its characters
    are null. Ids that are null draw as an empty id; rows that repeat are kept, each with the same result. Texts of
    any length are taken whole. An empty table gives an empty table."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(df[id_col].cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    source = df.select(df[id_col].alias("id"), text_or_empty(df, text_col).alias("text"), *draws)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8_buffers(batch.column(1))
            drawn = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False) for k in range(4)])
            row = 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(at, at[row] + STEP, side="right")) - 1)
                n, form, ahead, inside, out, borders = rearranged(data[at[row] : at[stop]], at[row : stop + 1] - at[row], drawn[:, row:stop], rate, suffix_first)
                plain = form == 0
                columns = [batch.column(0).slice(row, stop - row), pa.array(n), pa.array(FORMS[form]), pa.array(ahead, mask=plain), pa.array(inside, mask=plain), utf8_array(out, borders)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                row = stop

    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(cut, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made of. A text with a mark in it is plain, and a mark begins with < and ends
    with >, so that none arises where parts meet: the marks found are the marks put in."""
    parts = F.split(output, "<[PSM]>", -1)
    first, second, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def oracle_sql() -> str:
    def draw(k: int) -> str:
        return f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT"

    return rf"""
with cut as (
    select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as digest, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units from documents
), drawn as (
    select *, len(units) as n, {draw(0)} % (len(units) + 1) as c1, {draw(1)} % (len(units) + 1) as c2,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or {draw(2)} % 100 >= {RATE} then 'plain'
             when {draw(3)} % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from cut
), parts as (
    select *, array_to_string(units[1:least(c1, c2)], '') as prefix, array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') as middle, array_to_string(units[greatest(c1, c2) + 1:], '') as suffix from drawn
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(text) as restored_sha256
from parts"""
