"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Each step only counts narrow keys. A later, dearer key is computed for the rows
whose earlier key occurs more than once; the rest are known to be alone. Which
keys survive travels as a bitmap of fixed size (``GATE_WORDS`` rows at most), so
no step shuffles a text. The bitmap may let a row through whose key is in fact
unique; the exact grouping at the end settles that, so it costs time at most.

Defined results
    null text       counts as the empty text
    equal texts     identical after lower-casing A-Z only
    ties            rows that share the largest id of a group share its text too;
                    the report marks them all kept, ``drop_copies`` returns one
    null id         loses to any other id; a group of null ids keeps null
    empty table     an empty result with the same columns
    other columns   carried through; names that clash with a result column are
                    replaced by the result
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most rows of a gate, each of 64 bits: 2**18 rows (4 MB) are sixteen million keys.
GATE_WORDS = 1 << 18
PREFIX_CHARS = 64


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _word(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(GATE_WORDS))


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))


def gate(repeated: DataFrame, key: str) -> DataFrame:
    """The bitmap of ``key``: at most GATE_WORDS rows by construction."""
    return (
        repeated.select(_word(F.col(key)).alias("_w"), _bit(F.col(key)).alias("_b"))
        .groupBy("_w")
        .agg(F.bit_or("_b").alias("_bits"))
    )


def through(rows: DataFrame, gate: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be in the gate. The broadcast side has GATE_WORDS rows at most."""
    return (
        rows.withColumn("_w", _word(F.col(key)))
        .join(F.broadcast(gate), "_w", "inner")
        .where(F.col("_bits").bitwiseAND(_bit(F.col(key))) != 0)
        .drop("_w", "_bits")
    )


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, text_sha256`` of the rows that may have a copy."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    by_length = rows.withColumn("_len", F.octet_length("_t").cast("long"))
    lengths = by_length.groupBy("_len").count().where("count > 1")

    prefixed = through(by_length, gate(lengths, "_len"), "_len").withColumn(
        "_pre", F.xxhash64(F.col("_len"), ascii_lower(F.substring("_t", 1, PREFIX_CHARS)))
    )
    prefixes = prefixed.groupBy("_pre").count().where("count > 1")

    return through(prefixed, gate(prefixes, "_pre"), "_pre").select(
        "_id", F.sha2(ascii_lower(F.col("_t")), 256).alias("text_sha256")
    )


def _groups(hashed: DataFrame) -> DataFrame:
    return (
        hashed.groupBy("text_sha256")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of two or more equal texts: ``text_sha256, keep_id, group_size``.

    Written out, so that a join deals its rows by itself and can split a group.
    """
    return cut(_groups(_hashed(docs, id_col, text_col)))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``keep_id, group_size, kept, text_sha256``."""
    groups = copy_groups(docs, id_col, text_col)
    kept_columns = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    rows = docs.select(*kept_columns).withColumn("text_sha256", F.sha2(ascii_lower(docs[text_col]), 256))
    return (
        rows.join(groups, "text_sha256", "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest id.

    The rows to drop are found on hashes alone and taken away by their id, so
    texts are dealt by id and a large group of copies never meets in one task.
    That needs an id for each row: where an id of ``docs`` is null or occurs
    twice, rows are told apart by the hash of their text as well.
    """
    if not docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        kept = exact_duplicates(docs.select(F.struct(*docs.columns).alias("_row"), id_col, text_col), id_col, text_col).where("kept")
        return kept.dropDuplicates(["text_sha256"]).select("_row.*")
    hashed = cut(_hashed(docs, id_col, text_col))
    marked = hashed.join(cut(_groups(hashed)), "text_sha256")
    lost = marked.where(F.col("_id") != F.col("keep_id")).select(F.col("_id").alias(id_col))
    return docs.join(lost, id_col, "left_anti").select(*docs.columns)
