"""Text functions: words, hashes and identities."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Runs of letters and digits, A-Z lower-cased; every character past ASCII is a letter."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), 0)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def label(reply: Column) -> Column:
    """The first line of a reply, without the marks a model puts around a title."""
    first = F.regexp_replace(F.substring_index(reply, "\n", 1), r'^[ \t"*#]+', "")
    return F.regexp_replace(first, r'[ \t"*#.]+$', "")


def context_tokens(prompt: Column) -> Column:
    """A power of two from 4096 to 32768 that holds a third of the bytes and 1024 more."""
    wanted = F.octet_length(prompt) / 3 + 1024
    return F.least(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(wanted))), F.lit(4096.0)), F.lit(32768.0)).cast("int")


def topic_count(n: Column) -> Column:
    """How many topics to look for among ``n`` passages."""
    default = F.greatest(F.least(F.round(F.sqrt(n / 2)), F.lit(20)), F.lit(2))
    return F.when(n < 2, 0).when(n < 4, 2).otherwise(default).cast("int")


def blake2(size: int = 32):
    """A UDF: the BLAKE2b digest of binary or text, in lower-case hex. Spark has no such function."""

    @F.pandas_udf(T.StringType())
    def digest(values: pd.Series) -> pd.Series:
        raw = (v.encode() if isinstance(v, str) else bytes(v) if v is not None else None for v in values)
        return pd.Series([None if v is None else blake2b(v, digest_size=size).hexdigest() for v in raw], dtype=object)

    return digest


def model_id(family: str, version: str, quantisation: str, pooling: str, dimension: int, normalised: bool) -> str:
    """Identity of an embedding model: each field with its length, so that no two lists of fields run together."""
    fields = b"".join(struct.pack(">I", len(f.encode())) + f.encode() for f in ("embedding-model", family, version, quantisation, pooling))
    return blake2b(fields + struct.pack(">IB", dimension, normalised), digest_size=16).hexdigest()


def hashed_vector(tokens: list[str], dimension: int) -> np.ndarray:
    """Words, pairs and triples with weights 1, 2 and 3, each at a hashed place with a hashed sign; unit length."""
    return _hashed([t.encode() for t in tokens], dimension)


def _hashed(tokens: list[bytes], dimension: int) -> np.ndarray:
    v = np.zeros(dimension)
    if not tokens:
        v[0] = 1.0
        return v
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    for n in range(1, min(3, len(tokens)) + 1):
        spans = zip(starts[: len(tokens) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist())
        h = np.frombuffer(b"".join([blake2b(joined[a:b], digest_size=8).digest() for a, b in spans]), ">u8")
        sign = np.where(h >> np.uint64(32) & np.uint64(1), n, -n)
        v += np.bincount((h % np.uint64(dimension)).astype(np.int64), sign, dimension)
    length = float(np.sqrt((v * v).sum()))
    return v / length if length else v


def hashed_texts(dimension: int = 128) -> Callable[[list[str | None]], np.ndarray]:
    """An embedder: texts to a matrix of :func:`hashed_vector` of their words."""
    find = re.compile(rb"[a-z0-9\x80-\xff]+").findall
    return lambda texts: np.array([_hashed(find((t or "").encode("utf-8", "surrogatepass").lower()), dimension) for t in texts])


def embedded(embedder: Callable[[list[str | None]], np.ndarray]):
    """A UDF from texts to vectors by any embedder, a function from a list of texts to a matrix; null for a zero vector.

    The embedder travels to the tasks and is called a batch at a time, so a model is
    loaded once a worker where it keeps it.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        rows = embedder(texts.tolist()) if len(texts) else []
        return pd.Series([row if row.any() else None for row in rows], dtype=object)

    return embed


def hash_embed(dimension: int = 128):
    """A UDF from a text to its hashed vector; null where its words cancel out."""
    return embedded(hashed_texts(dimension))
