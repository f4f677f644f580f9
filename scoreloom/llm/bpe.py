"""Operator 8, byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of bytes exactly one token can be the last one of its BPE encoding. These last tokens are
found from left to right: a token that ends here is the last one if it may stand next to the last token of the prefix
that it leaves. Following the stored tokens back from the end gives the encoding. The state of a text can be kept:
appended bytes go on from it, and after an edit only what lies behind the last unchanged prefix is worked out again.

Which tokens end where comes from an automaton over all tokens; whether two tokens may stand next to each other from
the merges that the ranks imply."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, text_or_empty

#: Pieces that each Python worker keeps with their encodings, in each of two generations.
KEPT_PIECES = 500_000
#: Pairs of tokens that each worker remembers to fit or not.
KEPT_PAIRS = 500_000


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes pieces of bytes by the ranks of their tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.parts: dict[int, tuple[int, int]] = {}  # of a token that a merge makes: the two tokens merged
        self.adjacent: dict[int, bool] = {}  # by left << 32 | right
        self.matcher = ahocorasick.Automaton()  # over bytes written as characters of the same number
        for token, rank in ranks.items():
            if len(token) > 1:
                two = self._merged(token, rank)
                if len(two) != 2:
                    continue  # no merge leads to it: only a whole piece can be this token
                self.parts[rank] = two
            self.matcher.add_word(token.decode("latin-1"), rank)
        self.matcher.make_automaton()

    def _merged(self, token: bytes, below: int) -> tuple[int, ...]:
        """What merges of lower rank than `below` make of a token's bytes."""
        now = [token[i : i + 1] for i in range(len(token))]
        while len(now) > 1:
            rank, i = min((self.ranks.get(now[i] + now[i + 1], below), i) for i in range(len(now) - 1))
            if rank >= below:
                break
            now[i : i + 2] = [now[i] + now[i + 1]]
        return tuple(self.ranks[x] for x in now)

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens standing next to each other: no merge across their border comes earlier
        than the merges that make them."""
        key = left << 32 | right
        known = self.adjacent.get(key)
        if known is None:
            if len(self.adjacent) >= KEPT_PAIRS:
                self.adjacent.clear()
            known = self.adjacent[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        ranks, tokens, parts = self.ranks, self.tokens, self.parts
        limit = len(ranks)  # merges from this rank on have not happened on either side
        while True:
            merged = ranks.get(tokens[left] + tokens[right])
            if merged is not None and merged < limit and (merged in parts and parts[merged] == (left, right)):
                return False
            # Undo the later of the two merges; of equal merges BPE makes the left one first, so a merge across
            # the border that equals the right token's also comes before it.
            undo_left = left > right
            if (left if undo_left else right) not in parts:
                undo_left = not undo_left
                if (left if undo_left else right) not in parts:
                    return True
            if undo_left:
                limit, left = left, parts[left][1]
            else:
                limit, right = right + 1, parts[right][0]

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of the encoding of each prefix of piece (1 byte, 2 bytes, ...); -1 where there is none.

        known: the last tokens of a beginning of piece, which is not worked out again: appending bytes costs only
        these bytes."""
        lengths, adjacent, fits = self.lengths, self.adjacent, self.fits
        last = list(known or ())
        begun = len(last)
        last += [-1] * (len(piece) - begun)
        # Tokens that end behind `begun` start no more than the longest token before it.
        cut = max(0, begun - self.longest)
        for stop, token in self.matcher.iter(piece[cut:].decode("latin-1")):
            stop += cut
            if stop < begun or last[stop] >= 0:
                continue  # at most one token fits
            before = stop - lengths[token]
            if before < 0:
                last[stop] = token
                continue
            left = last[before]
            if left >= 0:
                fit = adjacent.get(left << 32 | token)
                if fits(left, token) if fit is None else fit:
                    last[stop] = token
        return last

    def edited(self, piece: bytes, last: list[int], new: bytes) -> list[int]:
        """The last tokens of new, given those of piece: kept as far as both begin alike, worked out over the edit, and
        taken from piece again where both end alike and as many in a row as the longest token has bytes agree."""
        most = min(len(piece), len(new))
        same = next((k for k in range(most) if piece[k] != new[k]), most)
        tail = next((k for k in range(most - same) if piece[-1 - k] != new[-1 - k]), most - same)
        moved, stop = len(new) - len(piece), len(new) - tail + self.longest
        now = last[:same]
        while stop < len(new):
            now = self.last_tokens(new[:stop], now)
            if now[stop - self.longest :] == last[stop - self.longest - moved : stop - moved]:
                return now + last[stop - moved :]
            stop += self.longest
        return self.last_tokens(new, now)

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece. A piece that is a token itself is this token, as in the rank files' own library."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last, out, at = self.last_tokens(piece), [], len(piece)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(read_ranks(path))


def bpe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, n_tokens, ids, decoded) for every row: ids as little-endian 32-bit numbers, decoded bytes of them.

    A null or empty text has no tokens; texts of any length are encoded whole. Rows are encoded one by one, without a
    shuffle; repeated rows and null ids keep their rows; an empty table stays empty."""
    return _run(df, id_col, text_col, ranks, pattern, lambda ids, back: (ids, back), "ids binary, decoded binary", (pa.binary(), pa.binary()))


def bpe_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): as bpe(), with digests made where the ids are."""
    hexed = lambda ids, back: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
    return _run(df, id_col, text_col, ranks, pattern, hexed, "ids_sha256 string, decoded_sha256 string", (pa.string(), pa.string()))


def _run(df: DataFrame, id_col: str, text_col: str, ranks: str | None, pattern: str | None, made, schema: str, kinds) -> DataFrame:
    path, split = ranks or default_ranks(), pattern or default_pattern()
    source = df.select(df[id_col].alias("id"), text_or_empty(df, text_col).alias("text"))
    names = ["id", "n_tokens", *(x.split()[0] for x in schema.split(", "))]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        store = Memo(lambda piece: array("I", enc.encode(piece.encode("utf-8", "replace"))).tobytes(), KEPT_PIECES)
        pieces = regex.compile(split).findall
        for b in batches:
            for at in range(0, b.num_rows, 512):  # results may be as large as the texts
                part = b.slice(at, 512)
                counts, left, right = [], [], []
                for t in part.column(1):
                    ids = b"".join(map(store.__getitem__, pieces(t.as_py())))
                    x, y = made(ids, enc.decode(array("I", ids)))
                    counts.append(len(ids) // 4)
                    left.append(x)
                    right.append(y)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(left, kinds[0]), pa.array(right, kinds[1])], names=names)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(encoded, f"id {kind}, n_tokens long, {schema}").withColumnRenamed("id", id_col)
