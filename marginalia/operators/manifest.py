"""The segment manifest as a table of operations, folded into one row per segment.

Operations are ``add``, ``tombstone`` and ``retire`` rows in any order and with
repeats; the fold is a union of sets, so it is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import numbered

TIER_RATIO = 4


def dealt(rows: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """``rows`` in ``parts`` by ``keys``: with as many as the table needs a task holds the same of any table."""
    return rows if parts is None else rows.repartition(parts, *keys)


def distinct_ops(ops: DataFrame, parts: int | None = None) -> DataFrame:
    """Each operation once, by its id; rows with no counter or an empty add are malformed and left out."""
    well = (F.col("counter") > 0) & ~((F.col("kind") == "add") & (F.coalesce("count", F.lit(0)) == 0))
    return dealt(ops.where(well), ["counter", "replica"], parts).dropDuplicates(["counter", "replica"])


def conflicting(ops: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds that say another count than the earliest add of their segment: ``counter, replica, segment, count, agreed``.

    A segment is named by its content, so whoever adds it again must count the same.
    """
    adds = dealt(distinct_ops(ops, parts).where("kind = 'add'").select("counter", "replica", "segment", "count"), ["segment"], parts)
    first = adds.groupBy("segment").agg(F.min(F.struct("counter", "replica", "count")).alias("first")).select("segment", F.col("first.count").alias("agreed"))
    return adds.join(first, "segment").where(F.col("count") != F.col("agreed")).select("counter", "replica", "segment", "count", "agreed")


def agreeing(ops: DataFrame) -> DataFrame:
    """The operations without adds that contradict an earlier one."""
    return ops.join(conflicting(ops).select("counter", "replica"), ["counter", "replica"], "left_anti")


def fold(ops: DataFrame, model: Column | None = None, parts: int | None = None) -> DataFrame:
    """``segment, count, bytes, added_at, added_by, dead, superseded_by``.

    The earliest add of the index's own model gives count and bytes; adds of
    another model are refused. A segment that only a tombstone or a retirement
    names has a null count. Adds that contradict an earlier one: :func:`conflicting`.
    """
    rows = distinct_ops(ops, parts)
    if model is not None:
        rows = rows.where((F.col("kind") != "add") | (F.col("model") == model))
    is_add = F.col("kind") == "add"
    first = F.min(F.when(is_add, F.struct("counter", "replica", "count", "bytes")))
    return (
        dealt(rows, ["segment"], parts).groupBy("segment")
        .agg(
            first.alias("add"),
            F.array_sort(F.collect_set(F.when(F.col("kind") == "tombstone", F.col("slot")))).alias("dead"),
            F.array_sort(F.collect_set(F.when(F.col("kind") == "retire", F.col("superseded_by")))).alias("superseded_by"),
        )
        .select(
            "segment", "add.count", "add.bytes", F.col("add.counter").alias("added_at"), F.col("add.replica").alias("added_by"), "dead", "superseded_by"
        )
    )


def counters(ops: DataFrame, model: Column, parts: int | None = None) -> DataFrame:
    """One row: operations applied, repeated, and refused for their model."""
    own = dealt(ops, ["counter", "replica"], parts).groupBy("counter", "replica").agg(F.count(F.lit(1)).alias("n"), F.first("kind").alias("kind"), F.first("model").alias("model"))
    return own.agg(
        F.count(F.lit(1)).alias("applied"),
        F.sum(F.col("n") - 1).alias("duplicate"),
        F.count_if((F.col("kind") == "add") & (F.col("model") != model)).alias("refused_model"),
    )


def superseded(state: DataFrame, present: DataFrame) -> DataFrame:
    """Segments with a replacement that is here: ``segment``."""
    by = state.select("segment", F.explode("superseded_by").alias("by"))
    return by.join(present.select(F.col("segment").alias("by")), "by", "left_semi").select("segment").distinct()


def live(state: DataFrame, present: DataFrame) -> DataFrame:
    """Known, here and not replaced by something that is here."""
    return state.join(present, "segment", "left_semi").join(superseded(state, present), "segment", "left_anti").select("segment")


def missing(state: DataFrame, present: DataFrame) -> DataFrame:
    """Added somewhere, not here and not replaced by something that is here."""
    wanted = state.where(F.col("count") > 0)
    return wanted.join(present, "segment", "left_anti").join(superseded(state, present), "segment", "left_anti").select("segment")


def droppable(state: DataFrame, present: DataFrame) -> DataFrame:
    """Here, and replaced by something that is here."""
    return state.join(present, "segment", "left_semi").join(superseded(state, present), "segment", "left_semi").select("segment")


def awaiting(state: DataFrame, present: DataFrame) -> DataFrame:
    """Retired and still needed, as no replacement has arrived."""
    retired = state.where(F.size("superseded_by") > 0).join(present, "segment", "left_semi")
    return retired.join(superseded(state, present), "segment", "left_anti").select("segment")


def fetch_order(state: DataFrame, present: DataFrame) -> DataFrame:
    """Segments that are added and not here: those nobody replaces first, then by id."""
    absent = state.where(F.col("count") > 0).join(present, "segment", "left_anti")
    replaced = F.size("superseded_by") > 0
    return numbered(absent.select("segment", replaced.alias("replaced")), ["replaced", "segment"])


def plan_compaction(
    segments: DataFrame, min_segments: int, max_dead_percent: int, tier_ratio: int = TIER_RATIO
) -> DataFrame:
    """Which of the live ``segments(segment, count, dead)`` to merge now; no rows where it is not worth it.

    The smallest segment and all within ``tier_ratio`` of its size are one tier:
    sizes are compared with one minimum, so no sort is needed to find it.
    """
    counted = segments.where(F.col("count") > 0)
    smallest = counted.agg(F.min("count").alias("smallest"))
    tier = counted.join(F.broadcast(smallest), F.col("count") <= F.col("smallest") * tier_ratio).select("segment", "count", "dead")
    total = tier.agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("all_vectors"), F.sum("dead").alias("dead_vectors"))
    percent = F.floor(F.col("dead_vectors") * 100 / F.col("all_vectors"))
    chosen = total.withColumn(
        "reason",
        F.when(F.col("n") < 2, None).when(F.col("n") >= min_segments, "segment count").when(percent >= max_dead_percent, "dead ratio"),
    ).where("reason IS NOT NULL")
    return tier.crossJoin(F.broadcast(chosen.select("reason"))).select("segment", "count", "dead", "reason")


def index_stats(entries: DataFrame, dead: DataFrame) -> DataFrame:
    """One row: segments, vectors, tombstoned, live objects. ``dead(segment, slot)``."""
    marked = entries.join(dead.distinct().withColumn("_dead", F.lit(True)), ["segment", "slot"], "left")
    gone = F.col("_dead").isNotNull()
    return marked.agg(
        F.count_distinct("segment").alias("segments"),
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(gone).alias("tombstoned"),
        F.count_distinct(F.when(~gone, F.col("object"))).alias("objects"),
    )


def live_entries(entries: DataFrame, dead: DataFrame) -> DataFrame:
    return entries.join(dead, ["segment", "slot"], "left_anti")
