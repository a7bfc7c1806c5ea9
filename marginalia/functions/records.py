"""Records as bytes and back, in built-in expressions: fixed numbers, sized texts, refused where malformed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG, TEXT = "long", "string"


def number(value: Column) -> Column:
    """A long as eight bytes, the most significant first, so that bytes sort as numbers do."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def sized(value: Column) -> Column:
    """A text in UTF-8 after its length in four bytes."""
    raw = F.encode(value, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 8, "0")), raw)


def pack(fields: list[tuple[str, Column]]) -> Column:
    """``fields`` as (kind, column) one after the other; null where a field is null."""
    return F.concat(*[number(c) if kind == LONG else sized(c) for kind, c in fields])


def _number_at(raw: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(F.substring(raw, F.least(at.cast("long"), F.lit((1 << 31) - 1)).cast("int"), F.lit(size))), 16, -10).cast("long")


def unpack(raw: Column, fields: list[tuple[str, str]]) -> Column:
    """A struct of ``fields`` as (kind, name); null where bytes are missing, left over or not UTF-8."""
    at, out, fine = F.lit(1).cast("long"), [], F.lit(True)
    for kind, name in fields:
        if kind == LONG:
            out.append(_number_at(raw, at, 8).alias(name))
            at = at + 8
        else:
            # a size past the end leaves the record too short, and so refused
            size = F.least(_number_at(raw, at, 4), F.octet_length(raw).cast("long"))
            text = F.substring(raw, F.least(at + 4, F.lit((1 << 31) - 1)).cast("int"), size.cast("int")).cast("string")
            fine = fine & F.is_valid_utf8(text)
            out.append(text.alias(name))
            at = at + 4 + size
    whole = at - 1 == F.octet_length(raw)
    return F.when(whole & fine, F.struct(*out))


def pack_marks(marks: Column) -> Column:
    """A map of longs as pairs in the order of their keys, the same bytes for the same map."""
    pair = lambda e: F.concat(F.hex(number(e["key"])), F.hex(number(e["value"])))
    return F.unhex(F.array_join(F.transform(F.array_sort(F.map_entries(marks)), pair), ""))


def unpack_marks(raw: Column) -> Column:
    """The pairs; null where bytes are left over, a mark is 0, or keys are not ascending."""
    count = F.floor(F.octet_length(raw) / 16).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    read = lambda i: F.struct(_number_at(raw, i * 16 + 1, 8).alias("key"), _number_at(raw, i * 16 + 9, 8).alias("value"))
    pairs = F.transform(places, read)
    keys = F.transform(pairs, lambda e: e["key"])
    ascending = keys == F.array_sort(F.array_distinct(keys))
    return F.when((F.octet_length(raw) % 16 == 0) & ascending & F.forall(pairs, lambda e: e["value"] != 0), pairs)


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above every key with ``prefix``; None where there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def has_prefix(key: Column, prefix: bytes) -> Column:
    """As a range, which reaches the scan as a pushed filter."""
    end = prefix_end(prefix)
    inside = key >= F.lit(prefix)
    return inside if end is None else inside & (key < F.lit(end))


def is_loopback(url: Column) -> Column:
    """Whether the host of a URL is this machine: 127.0.0.0/8, ::1 or localhost."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)
    return host.isin("localhost", "[::1]") | host.rlike(r"^127(\.[0-9]{1,3}){3}$")


def seal(text: Column, key: bytes, about: Column) -> Column:
    """Authenticated encryption that gives equal bytes for equal text, key and ``about``.

    The nonce is derived from all three. The key is part of the plan: take it from
    where only this job can read it.
    """
    raw = F.encode(text, "UTF-8")
    keyed = F.concat(F.lit(key), F.unhex(F.sha2(about.cast("binary"), 256)), F.unhex(F.sha2(raw, 256)), F.lit(key))
    nonce = F.unhex(F.substring(F.sha2(keyed, 256), 1, 24))
    return F.aes_encrypt(raw, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce, about.cast("binary"))


def unseal(sealed: Column, key: bytes, about: Column) -> Column:
    """The text; null where the bytes, the key or ``about`` are not those it was sealed with."""
    return F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), about.cast("binary")).cast("string")
