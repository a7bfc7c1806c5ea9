"""Operations as bytes and back: versioned, and refused where malformed."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 1
HEAD = struct.Struct(">BQH")


def encode_move(counter: int, replica: str, child: str, parent: str, name: str, is_dir: bool) -> bytes:
    parts = [s.encode() for s in (replica, child, parent, name)]
    return HEAD.pack(VERSION, counter, is_dir) + b"".join(struct.pack(">I", len(p)) + p for p in parts)


def decode_move(raw: bytes) -> tuple | None:
    """None for another version, bytes that are left over or missing, or text that is not UTF-8."""
    if len(raw) < HEAD.size:
        return None
    version, counter, is_dir = HEAD.unpack_from(raw)
    at, parts = HEAD.size, []
    try:
        for _ in range(4):
            (n,) = struct.unpack_from(">I", raw, at)
            part = raw[at + 4 : at + 4 + n]
            if len(part) != n:
                return None
            parts.append(part.decode())
            at += 4 + n
    except (struct.error, UnicodeDecodeError):
        return None
    if version != VERSION or at != len(raw) or counter == 0 or is_dir > 1:
        return None
    return (counter, parts[0], parts[1], parts[2], parts[3], bool(is_dir))


def moves_to_bytes(counter: Column, replica: Column, child: Column, parent: Column, name: Column, is_dir: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def encode(c: pd.Series, r: pd.Series, ch: pd.Series, p: pd.Series, n: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([encode_move(int(a), *map(str, b), bool(e)) for a, *b, e in zip(c, r, ch, p, n, d)], dtype=object)

    return encode(counter, replica, child, parent, name, is_dir)


def moves_from_bytes(raw: Column) -> Column:
    """A struct of the move's fields; all null where the bytes are refused."""
    kind = "counter long, replica string, child string, parent string, name string, is_dir boolean"

    @F.pandas_udf(kind)
    def decode(values: pd.Series) -> pd.DataFrame:
        rows = [decode_move(bytes(v)) if v is not None else None for v in values]
        return pd.DataFrame([r or (None,) * 6 for r in rows], columns=[c.split()[0] for c in kind.split(", ")]).astype({"counter": "Int64", "is_dir": "boolean"})

    return decode(raw)
