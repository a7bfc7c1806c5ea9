"""Byte-level BPE encoding and decoding that reproduces the exact merges in linear time.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds every token at every position in one pass. A piece is then read
from the left by longest matches. A token may follow another only if BPE, given
the two side by side, would never have merged across the seam; that is decided by
undoing their merges from the last one back, and remembered per pair. When no
token fits, the last choice is shortened. The BPE encoding of a prefix is unique,
so a position found to lead nowhere never needs a second visit: time stays linear.

The vocabulary is read once by the driver and travels as a broadcast of its fixed
size. Pieces that come again are answered from a memo of bounded size.

Defined results
    null or empty text   no ids; decodes to the empty text
    long texts           encoded whole, a piece at a time
    null ids             decode to no bytes
    unknown ids          an error: they are not in the vocabulary
    empty table          an empty result
    other columns        carried through; clashing names are replaced
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.pretokens import Memo, splitter
from marginalia.session import bounded_batches

#: Pieces and token pairs that a worker remembers.
PIECES, PAIRS = 300_000, 1_000_000


def read_ranks(text: bytes) -> list[bytes]:
    """Tokens in order of rank, from lines of base64 and a rank."""
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, text.splitlines()))
    return [token for _, token in ranked]


class Codec:
    """Encoder and decoder of one vocabulary; ids are ranks."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.split = splitter(pattern)
        self.ids = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.parts: list[tuple[int, int] | None] = [None] * len(tokens)
        self.merged: dict[tuple[int, int], int] = {}
        self.fits = Memo(self._fits, PAIRS)
        self._learn_merges()
        self.fits.clear()
        self.finder = ahocorasick.Automaton()
        for word, i in self.ids.items():
            self.finder.add_word(word, (len(word), i))
        self.finder.make_automaton()
        self.pieces = Memo(self._piece_bytes, PIECES)

    def _learn_merges(self) -> None:
        """The last merge of each token: the one cut whose halves are stable side by side."""
        for word, i in self.ids.items():
            for cut in range(1, len(word)):
                a, b = self.ids.get(word[:cut]), self.ids.get(word[cut:])
                if a is not None and b is not None and a < i and b < i and self._fits((a, b)):
                    self.parts[i] = (a, b)
                    self.merged[a, b] = i
                    break

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether BPE leaves the two tokens unmerged when one follows the other.

        The younger of the two is taken apart, so the state goes back in time. A
        merge across the seam is the one BPE would have preferred if it is older
        than the merge just undone; on a tie the left of two equal merges is first.
        """
        a, b = pair
        undone = len(self.tokens) + 1
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < undone:
                return False
            left, right = self.parts[a], self.parts[b]
            if left is None and right is None:
                return True
            if right is None or (left is not None and a > b):
                undone, a = a, left[1]
            else:
                undone, b = b + 1, right[0]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for last, (length, token) in self.finder.iter(piece):
            at[last + 1 - length].append((last + 1, token))
        dead, fits = bytearray(n + 1), self.fits
        path: list[tuple[int, int, int]] = []
        pos, before, choice = 0, -1, len(at[0])
        while pos < n:
            options = at[pos]
            while choice:
                choice -= 1
                end, token = options[choice]
                if not dead[end] and (before < 0 or fits[before, token]):
                    path.append((pos, choice, token))
                    pos, before, choice = end, token, len(at[end])
                    break
            else:
                dead[pos] = 1
                if not path:
                    raise ValueError("the vocabulary lacks a byte of this text")
                pos, choice, _ = path.pop()
                before = path[-1][2] if path else -1
        return [token for _, _, token in path]

    def _piece_bytes(self, piece: str) -> bytes:
        return array("I", self.encode_piece(piece.encode("utf-8", "surrogatepass").decode("latin-1"))).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        self.pieces.trim()
        self.fits.trim()
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), np.int32)

    def decode(self, ids) -> bytes:
        return b"" if ids is None else b"".join(map(self.tokens.__getitem__, np.asarray(ids, np.int64).tolist()))


_CODECS: dict[tuple[int, str], Codec] = {}


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec per vocabulary and Python worker."""
    key = (hash(vocabulary), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(vocabulary), pattern)
    return _CODECS[key]


def shared_vocabulary(spark: SparkSession, path: str) -> Callable[[], bytes]:
    """The vocabulary file, read by the driver and broadcast; under a MB for 50,000 tokens."""
    with open(path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    return lambda: held.value


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text."""
    vocabulary = shared_vocabulary(docs.sparkSession, path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(vocabulary(), pattern)
        return pd.Series([c.encode(t) for t in texts], dtype=object)

    bounded_batches(docs.sparkSession)
    return docs.withColumn(ids_col, ids(F.col(text_col)))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that each array of ids stands for."""
    vocabulary = shared_vocabulary(rows.sparkSession, path)

    @F.pandas_udf(T.BinaryType())
    def back(ids: pd.Series) -> pd.Series:
        c = codec(vocabulary(), pattern)
        return pd.Series([c.decode(x) for x in ids], dtype=object)

    bounded_batches(rows.sparkSession)
    return rows.withColumn(bytes_col, back(F.col(ids_col)))
