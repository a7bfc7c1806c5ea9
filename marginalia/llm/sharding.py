"""Sharding by vector bin packing: bytes, words and rows balanced jointly, equal texts together.

Rows are grouped by their text, and a group is a vector of what it takes of a shard in each
of the three measures. It goes where the weighted dot product with the residual capacity is
highest, the groups with most bytes first.
That is a fold, so it is dealt out by size: groups are sorted into classes by their largest
share of a shard, each class ``STEP`` times smaller than the one before, and a class is
packed in chunks of about ``CHUNK`` groups, each a task of its own that fills what its part
of the class may take of the residual capacity. What the classes before have taken is 3
numbers a shard; the smaller groups of the next class even out what the larger ones left.
The first class is one chunk: at most ``3 * shards * STEP`` groups can be that large.

Equal texts stay together unless they don't fit into one shard: such a group is dealt by
row into pieces of half a shard at most, of which there are ``12 * shards`` at most.

Defined results
    null text       counts as the empty text
    null ids, repeated ids and rows   every row has its place; rows are told apart by where they were read
    ties            the lowest shard of those that score alike; groups of a size by the hash of their text
    empty shards    where there are fewer groups than shards
    empty table     an empty result
    other columns   not kept
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import cut

STEP, CHUNK = 64, 20_000
#: Rows of a shard that are numbered in one place.
SLOT_ROWS = 20_000
#: Bytes that a row takes besides its text.
OVERHEAD = 16
MEASURES = ("bytes", "words", "rows")
#: What a measure counts for in the dot product: bytes are to be as near equal as can be, words and rows as near as that leaves.
WEIGHTS = (64.0, 1.0, 1.0)
GROUP = ("h1", "h2")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A narrow row for each document, written out: what follows never reads a text again, and ``place`` stays as it is."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return cut(
        docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
            "doc_id",
            (F.octet_length("_t") + OVERHEAD).cast("long").alias("size"),
            words(F.col("_t")).alias("words"),
            F.crc32(F.encode("_t", "UTF-8")).alias("text_crc32"),
            F.xxhash64("_t").alias("h1"),
            F.xxhash64("_t", F.lit("second")).alias("h2"),
            F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("place"),
        )
    )


def _share(sizes: dict[str, float]) -> Column:
    """The largest part of a shard that a group takes in any measure."""
    return F.greatest(*[F.col(m) / F.lit(float(max(sizes[m], 1e-9))) for m in MEASURES])


def place(items: np.ndarray, residual: np.ndarray, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each item, one after the other: where its dot product with the residual capacity is highest.

    ``items`` are (n, 3) and ``residual`` (shards, 3), both as parts of a shard; ``residual`` is used up.
    """
    out = np.empty(len(items), np.int32)
    for k, item in enumerate(items):
        out[k] = best = int(np.argmax(residual @ (item * weights)))
        residual[best] -= item
    return out


def _packed(units: DataFrame, capacity: np.ndarray, residual: np.ndarray, totals: np.ndarray) -> DataFrame:
    """``h1, h2, piece, shard, bytes, words, rows`` of units of one class, chunk by chunk.

    ``totals`` are what the whole class holds, as parts of a shard.
    """

    def task(chunk: pd.DataFrame) -> pd.DataFrame:
        items = chunk[list(MEASURES)].to_numpy(np.float64) / capacity
        order = np.lexsort((chunk["piece"], chunk["h2"], chunk["h1"], -items.sum(axis=1), -items[:, 0]))
        chunk, items = chunk.iloc[order], items[order]
        share = np.divide(items.sum(axis=0), totals, out=np.zeros(3), where=totals > 0)
        return chunk.assign(shard=place(items, residual * share))[["h1", "h2", "piece", "shard", *MEASURES]]

    schema = "h1 long, h2 long, piece int, shard int, bytes long, words long, rows long"
    return units.groupBy("chunk").applyInPandas(task, schema)


def _placed(units: DataFrame, shards: int, sizes: dict[str, float]) -> list[DataFrame]:
    """Tables of placed units, the first of them of bounded size: the largest groups."""
    capacity = np.array([max(sizes[m], 1e-9) for m in MEASURES])
    residual = np.ones((shards, 3)) * np.array([sizes[m] > 0 for m in MEASURES])
    level = F.greatest(F.floor(-F.log(_share(sizes)) / math.log(STEP)), F.lit(0)).cast("int")
    classed = cut(units.withColumn("level", level))
    sums = classed.groupBy("level").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in MEASURES]).orderBy("level").collect()
    done = []
    for at in sums:
        chunks = 1 if at.level == 0 else -(-at.n // CHUNK)
        some = classed.where(F.col("level") == at.level).withColumn("chunk", F.pmod(F.xxhash64(*GROUP, "piece", F.lit("chunk")), F.lit(chunks)))
        done.append(cut(_packed(some, capacity, residual, np.array([at[m] for m in MEASURES]) / capacity)))
        # one row a shard
        for used in done[-1].groupBy("shard").agg(*[F.sum(m).alias(m) for m in MEASURES]).collect():
            residual[used.shard] -= np.array([used[m] for m in MEASURES]) / capacity
        if at is sums[0] and at.level != 0:
            done.insert(0, done[0].limit(0))
    return done


def _slots(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """``rows`` with ``slot``: their number in their shard from 0, by ranges of a hash and numbered inside each."""
    ranges = max(8, -(-n // (shards * SLOT_ROWS)))
    dealt = cut(rows.withColumn("range", F.pmod(F.xxhash64("doc_id", *GROUP, "place"), F.lit(ranges))))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", *GROUP, "place"))
    return dealt.withColumn("inside", inside).join(bases, ["shard", "range"]).withColumn("slot", F.col("base") + F.col("inside") - 1)


def pack(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, words, text_crc32, shard, slot`` (the id under the name of ``id_col``)."""
    rows = _rows(docs, id_col, text_col)
    groups = rows.groupBy(*GROUP).agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows"))
    total = groups.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]).first()
    sizes = {m: total[m] / shards for m in MEASURES}
    # more than a shard each, so 3 * shards groups at most
    too_large = groups.where(_share(sizes) > 1).select(*GROUP, F.ceil(2 * _share(sizes)).cast("int").alias("pieces"))
    piece = F.when(F.col("pieces").isNotNull(), F.pmod("place", F.col("pieces"))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(too_large), [*GROUP], "left").withColumn("piece", piece).drop("pieces")
    units = rows.groupBy(*GROUP, "piece").agg(F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows"))
    placed = _placed(units, shards, sizes)
    if not placed:
        out = rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    else:
        first, *rest = [p.select(*GROUP, "piece", "shard") for p in placed]
        # 3 * shards * STEP groups and 12 * shards pieces at most; all others are less than 1 / (shards * STEP) of the rows
        held = rows.join(F.broadcast(first.withColumnRenamed("shard", "large")), [*GROUP, "piece"], "left")
        for more in rest[1:]:
            rest[0] = rest[0].unionByName(more)
        held = held.join(rest[0], [*GROUP, "piece"], "left") if rest else held.withColumn("shard", F.lit(None).cast("int"))
        out = _slots(held.withColumn("shard", F.coalesce("large", "shard")), total["rows"], shards)
    return out.select(F.col("doc_id").alias(id_col), "size", "words", "text_crc32", "shard", "slot")
