"""Exact ids of a byte-level BPE by dynamic programming over prefixes (problem 6).

The merge rules give every byte string one encoding, and that of each of its prefixes ends with one token. The last token of
a prefix is the only token that is a suffix of the prefix and may follow the last token of what precedes it. So one pass over
the bytes, with an automaton that reports all tokens ending at each byte, finds the last token of every prefix; following
these back from the end emits the ids. Two tokens may follow each other if encoding their concatenation yields just them,
which is found from the merge rules alone.

The text is split by the vocabulary's pattern first, and pieces that recur are remembered.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from recallgrid.session import spread

#: The published pattern of this family of vocabularies; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Entries that a worker remembers before it starts anew, and the longest piece remembered.
PIECES, PAIRS, PIECE_LENGTH = 300_000, 1_500_000, 24


class PrefixEncoder:
    """Encoder of one rank file. ``ranks`` maps each token's bytes to its id; ids are in order of the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.find = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.length = [0] * size
        #: The two tokens whose merge makes a token; a single byte is its own half on both sides.
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.length[i] = len(token)
            self.automaton.add_word(token.decode("latin-1"), i)
            if len(token) > 1:
                a, b = self._halves(token, i, ranks)
                self.left[i], self.right[i] = a, b
                self.merged[a, b] = i
        self.automaton.make_automaton()
        self.pieces: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    @staticmethod
    def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
        """The token's parts after all merges of lower rank: two, as the vocabulary comes from merges."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[at] + parts[at + 1], rank) >= rank:
                raise ValueError(f"token {rank} isn't the merge of two others")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and then ``b`` as they are: undoing merges from the latest, none across the border comes first."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        merged, left, right = self.merged, self.left, self.right
        bar = len(self.length)
        good = True
        while True:
            across = merged.get((a, b))
            if across is not None and across < bar:
                good = False
                break
            # Undo the later of the two tokens' own merges; the tokens at the border then existed until that merge.
            undo_a = a > b
            if undo_a and right[a] == a:
                undo_a = False
            elif not undo_a and left[b] == b:
                if right[a] == a:
                    break
                undo_a = True
            if undo_a:
                bar, a = a, right[a]
            elif left[b] == b:
                break
            else:
                # A merge across the border goes before an equal one to its right, as merges run from left to right.
                bar, b = b + 1, left[b]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def encode_piece(self, data: bytes) -> list[int]:
        n = len(data)
        last = [-1] * (n + 1)
        length, may_follow = self.length, self.may_follow
        for end, token in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - length[token]
                if start == 0 or (last[start] >= 0 and may_follow(last[start], token)):
                    last[end] = token
        ids = []
        while n:
            ids.append(last[n])
            n -= length[last[n]]
        ids.reverse()
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        pieces, extend = self.pieces, ids.extend
        for piece in self.find(text):
            found = pieces.get(piece)
            if found is None:
                found = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= PIECE_LENGTH:
                    if len(pieces) >= PIECES:
                        pieces.clear()
                    pieces[piece] = found
            extend(found)
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """The encoder of a rank file (lines of base64 and id), once per worker."""
    with open(path, "rb") as f:
        return PrefixEncoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """Rows ``(key, ids)``: every text's ids; a null or empty text has the empty list, never null. Markers of special tokens are ordinary text.

    A map without shuffle; whole texts. Rows with null or repeated keys come out as they are; further columns are ignored.
    """
    source = documents.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    out = StructType([StructField("_key", source.schema["_key"].dataType), StructField("ids", ArrayType(IntegerType()))])

    def encode(batches):
        encode_text = encoder(ranks).encode
        for batch in batches:
            ids = [np.asarray(encode_text(t) if t else [], dtype=np.int32) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["_key", "ids"])

    return spread(source).mapInArrow(encode, out).select(F.col("_key").alias(key), "ids")
