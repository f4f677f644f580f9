"""Operator 6, token counts: greedy longest-match word pieces, counted in linear time by an automaton.

The automaton is a trie of the vocabulary in which every node has a failure link and the number of pieces that
following this link pops: when no edge fits, the pieces that are certain are counted at once and matching goes on
from the node of what remains. Each character is looked at once; no piece is ever built."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, text_or_empty

MARK = "▁"  # starts the first piece of a word in the vocabulary
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")
#: Words that each Python worker keeps with their counts, in each of two generations.
KEPT_WORDS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


class LongestMatch:
    """Counts greedy longest-match pieces. A character that no piece starts with counts as its UTF-8 bytes."""

    def __init__(self, pieces: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in dict.fromkeys(pieces):
            at = 0
            for c in piece:
                nxt = self.edges[at].get(c)
                if nxt is None:
                    nxt = self.edges[at][c] = len(self.edges)
                    self.edges.append({})
                    ends.append(False)
                at = nxt
            if piece:
                ends[at] = True
        self.fail = [0] * len(self.edges)
        self.popped = [0] * len(self.edges)
        self._link(ends)

    def _link(self, ends: list[bool]) -> None:
        """Breadth-first, so that the links of shorter strings are there. A node that ends a piece pops just this
        piece. A single character that is no piece pops its bytes, so every link leads somewhere. Another node
        follows its parent's links until one has an edge for its character."""
        queue = [0]
        for parent in queue:
            for c, node in self.edges[parent].items():
                queue.append(node)
                if ends[node]:
                    self.popped[node] = 1
                elif parent == 0:
                    self.popped[node] = len(c.encode("utf-8", "surrogatepass"))
                else:
                    at, pops = self.fail[parent], self.popped[parent]
                    while at and c not in self.edges[at]:
                        pops += self.popped[at]
                        at = self.fail[at]
                    if c in self.edges[at]:
                        self.fail[node] = self.edges[at][c]
                    else:  # c begins no piece at all: what stands before it is popped, c counts as bytes
                        pops += len(c.encode("utf-8", "surrogatepass"))
                    self.popped[node] = pops

    def count(self, word: str) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        at = n = 0
        for c in word:
            while c not in edges[at]:
                if at == 0:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    break
                n += popped[at]
                at = fail[at]
            else:
                at = edges[at][c]
        while at:
            n += popped[at]
            at = fail[at]
        return n


def greedy_pieces(word: str, pieces: set[str], longest: int) -> int:
    """The same count by trying every length, longest first: what tests compare with."""
    n = at = 0
    while at < len(word):
        for stop in range(min(len(word), at + longest), at, -1):
            if word[at:stop] in pieces:
                n, at = n + 1, stop
                break
        else:
            n, at = n + len(word[at].encode("utf-8", "surrogatepass")), at + 1
    return n


@lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    return LongestMatch(read_vocabulary(path))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, n_words, n_tokens) for every row of df: words are runs without ASCII white space, of the whole text,
    however long.

    A null or empty text has 0 of both. Every row is counted by itself: no shuffle; repeated rows and null ids keep
    their rows; an empty table stays empty. The
    vocabulary (path of a sentencepiece model) is read by each Python worker once; it must be on the executors."""
    path = vocabulary or default_vocabulary()
    source = df.select(df[id_col].alias("id"), text_or_empty(df, text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        counts = Memo(lambda word: machine.count(MARK + word.decode("utf-8", "surrogatepass")), KEPT_WORDS)
        for b in batches:
            words = [0] * b.num_rows
            tokens = [0] * b.num_rows
            for i, t in enumerate(b.column(1).cast(pa.binary())):
                split = t.as_py().split()
                words[i] = len(split)
                tokens[i] = sum(map(counts.__getitem__, split))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(counted, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
