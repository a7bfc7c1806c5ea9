"""Index maintenance: replacing an object's vectors, merging segments, adopting foreign ones.

A segment is named by its content, so writing the same passages again changes
nothing. Data goes first and the manifest second: a reader never sees a segment
named that is not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import numbered


def contents(entries: DataFrame) -> DataFrame:
    """``object, content``: a digest of each object's ranges and vectors in order."""
    row = F.concat_ws(":", "ordinal", "start", "end", F.array_join(F.col("vector").cast("array<string>"), ","))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", row.alias("row"))))
    return entries.groupBy("object").agg(F.sha2(F.array_join(listed.getField("row"), "\n"), 256).alias("content"))


def put(entries: DataFrame, index: DataFrame, generation: int = 0) -> tuple[DataFrame, DataFrame]:
    """New entries ``segment, slot, object, ...`` and tombstones ``segment, slot`` for the objects in ``entries``.

    An object whose content is what the live ``index`` holds adds nothing and
    buries nothing, in whatever segment it is by now. ``generation`` counts what was
    buried or retired so far and is part of a new segment's name, so content that
    comes back is not taken for the buried segment it once was.
    """
    held = contents(index.join(entries.select("object").distinct(), "object", "left_semi"))
    changed = contents(entries).join(held, ["object", "content"], "left_anti")
    name = F.substring(F.sha2(F.concat_ws("/", "content", F.lit(str(generation))), 256), 1, 32)
    named = entries.join(changed.select("object", name.alias("segment")), "object")
    added = named.withColumn("slot", F.row_number().over(Window.partitionBy("segment").orderBy("object", "ordinal")) - 1)
    return added, index.join(changed.select("object"), "object", "left_semi").select("segment", "slot")


def remove(objects: DataFrame, index: DataFrame) -> DataFrame:
    """Tombstones for every entry of the given objects."""
    return index.join(objects, "object", "left_semi").select("segment", "slot")


def compact(entries: DataFrame, dead: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live entries of the ``inputs`` as one segment, and retirements ``segment, superseded_by``.

    The result is named by what it holds; a name among the inputs means that
    nothing would change, and then nothing is returned.
    """
    live = entries.join(inputs, "segment", "left_semi").join(dead, ["segment", "slot"], "left_anti")
    mark = F.xxhash64("segment", "slot")
    name = live.agg(F.concat(F.lower(F.hex(F.sum(F.pmod(mark, F.lit(1 << 40))))), F.lit("-"), F.count(F.lit(1)).cast("string")).alias("merged"))
    name = name.join(inputs.select(F.col("segment").alias("merged")), "merged", "left_anti")
    base = live.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(base, ["segment"], "base", F.col("n")).select("segment", "base")
    inside = F.row_number().over(Window.partitionBy("segment").orderBy("slot")) - 1
    merged = live.withColumn("_in", inside).join(placed, "segment").crossJoin(F.broadcast(name))
    rows = merged.withColumn("slot", (F.col("base") + F.col("_in")).cast("long")).withColumn("segment", F.col("merged")).drop("_in", "base", "merged")
    return rows, inputs.crossJoin(F.broadcast(name)).select("segment", F.col("merged").alias("superseded_by"))


def opened(manifest: DataFrame, entries: DataFrame, model: str, dimension: int) -> DataFrame:
    """Every segment that ``manifest(segment, model, dimension, count, digest)`` names: ``segment, refused``.

    ``refused`` is null where the segment may be searched, and else says why not: it is
    of another model or width, its entries are missing, fewer or more than were
    written, or not the ones whose digest was stored.
    """
    held = digests(entries).select("segment", F.col("count").alias("_count"), F.col("digest").alias("_digest"))
    reason = F.when(F.col("model") != model, "model-mismatch").when(F.col("dimension") != dimension, "width-mismatch").when(
        F.col("_count").isNull(), "missing"
    ).when(F.col("_count") != F.col("count"), "truncated").when(F.col("_digest") != F.col("digest"), "damaged")
    return manifest.join(held, "segment", "left").select("segment", reason.alias("refused"))


def digests(entries: DataFrame) -> DataFrame:
    """``segment, count, digest``: of all that a segment's entries hold, in order of their slots."""
    columns = sorted(c for c in entries.columns if c != "segment")
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    listed = F.array_sort(F.collect_list(F.struct("slot", row.alias("row"))))
    return entries.groupBy("segment").agg(F.count(F.lit(1)).alias("count"), F.sha2(F.array_join(listed.getField("row"), ","), 256).alias("digest"))


def adoptable(segments: DataFrame, model: str, dimension: int) -> DataFrame:
    """Foreign segments that may be searched here, with the reason where one may not."""
    reason = F.when(F.col("model") != model, "model-mismatch").when(F.col("dimension") != dimension, "width-mismatch").when(
        F.col("digest") != F.col("segment"), "damaged"
    )
    return segments.withColumn("refused", reason)
