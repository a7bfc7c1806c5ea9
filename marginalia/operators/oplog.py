"""The operation log: ordered scans, gap detection, cursors and logical watermarks.

A row is ``object, replica, counter, prev`` and a payload. ``prev`` is the counter
that its writer last wrote for the object, 0 for the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import numbered

PAGE_CAP, WINDOW, PIECE = 512, 64, 4 << 20


def distinct_ops(ops: DataFrame) -> DataFrame:
    """A grow-only union: each operation once, by the object and its writer's counter."""
    return ops.dropDuplicates(["object", "replica", "counter"])


def chain(*extra: str) -> Window:
    return Window.partitionBy("object", "replica", *extra).orderBy("counter")


def gaps(ops: DataFrame) -> DataFrame:
    """``gap``: the row's predecessor is not the row before it."""
    return ops.withColumn("gap", F.lag("counter", 1, 0).over(chain()) != F.col("prev"))


def accepted_prefix(ops: DataFrame) -> DataFrame:
    """Of each source the rows before its first gap; the rest wait."""
    so_far = chain().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = gaps(ops).withColumn("_gaps", F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(so_far))
    return seen.where("_gaps = 0").drop("_gaps", "gap")


def out_of_order(arrivals: DataFrame) -> DataFrame:
    """``arrivals`` with ``seq``: rows whose counter does not exceed one that came before."""
    before = Window.partitionBy("object", "replica").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return arrivals.withColumn("_high", F.max("counter").over(before)).where(F.col("counter") <= F.col("_high")).drop("_high")


def high_water(ops: DataFrame) -> DataFrame:
    return ops.groupBy("object", "replica").agg(F.max("counter").alias("high"))


def after(ops: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows past each source's cursor; a source without a cursor is read from the start."""
    joined = ops.join(cursors.select("object", "replica", F.col("counter").alias("_seen")), ["object", "replica"], "left")
    return joined.where(F.col("counter") > F.coalesce("_seen", F.lit(0))).drop("_seen")


def page(ops: DataFrame, limit: int) -> DataFrame:
    """The next rows of each source, and whether more follow."""
    n = min(limit, PAGE_CAP)
    placed = ops.withColumn("place", F.row_number().over(chain()))
    total = Window.partitionBy("object", "replica")
    return placed.withColumn("more", F.count(F.lit(1)).over(total) > n).where(F.col("place") <= n)


def last_write(ops: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the value of the highest (counter, replica); one aggregation, no sort."""
    return ops.groupBy(key).agg(F.max(F.struct("counter", "replica", value)).alias("w")).select(
        key, F.col("w.counter").alias("counter"), F.col("w.replica").alias("replica"), F.col(f"w.{value}").alias(value)
    )


def coalesced_deletes(ids: DataFrame) -> DataFrame:
    """Runs of consecutive counters of one replica: ``object, replica, counter, count``. A chain may be of any length."""
    each = numbered(ids.select("object", "replica", "counter").distinct(), ["counter"], "_place", within=("object", "replica"))
    runs = each.withColumn("_island", F.col("counter") - F.col("_place"))
    return runs.groupBy("object", "replica", "_island").agg(F.min("counter").alias("counter"), F.count(F.lit(1)).alias("count")).drop("_island")


def compaction_watermark(reports: DataFrame, devices: DataFrame, produced: DataFrame) -> DataFrame:
    """One row, ``watermark``: what every enrolled device has seen of every source that wrote.

    ``reports(device, clock, have: map)``, ``devices(device)``, ``produced(replica)``.
    It is 0 while an enrolled device is silent or none is enrolled.
    """
    known = devices.join(reports, "device", "left")
    sources = produced.select("replica").distinct()
    heard = known.where("clock IS NOT NULL")
    # a source that fewer devices than all have heard of stands at 0
    marks = heard.select("device", F.explode("have").alias("replica", "mark")).groupBy("replica").agg(F.count(F.lit(1)).alias("seen"), F.min("mark").alias("low"))
    devices_heard = heard.agg(F.count(F.lit(1)).alias("all"))
    acked = sources.join(marks, "replica", "left").crossJoin(F.broadcast(devices_heard)).where(F.col("all") > 0)
    low = acked.agg(F.min(F.when(F.col("seen") == F.col("all"), F.col("low")).otherwise(0)).alias("acked"))
    each = known.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("clock").isNull()).alias("silent"), F.min("clock").alias("clock"))
    value = F.when((F.col("n") == 0) | (F.col("silent") > 0), F.lit(0)).otherwise(F.least("clock", F.coalesce("acked", "clock")))
    return each.crossJoin(low).select(value.cast("long").alias("watermark"))


def text_watermark(held: DataFrame, replicas: DataFrame) -> DataFrame:
    """Per origin the least, over all replicas, of the last id each holds; 0 where one holds none.

    ``held(replica, origin, counter)``.
    """
    known = replicas.select("replica").distinct()
    top = held.groupBy("replica", "origin").agg(F.max("counter").alias("top"))
    # origins that any replica holds; those that some known replica lacks stand at 0
    marks = top.join(known.withColumn("_asked", F.lit(True)), "replica", "left").groupBy("origin").agg(
        F.count("_asked").alias("holders"), F.min(F.when(F.col("_asked"), F.col("top"))).alias("low")
    )
    total = F.broadcast(known.agg(F.count(F.lit(1)).alias("all")))
    return marks.crossJoin(total).where(F.col("all") > 0).select("origin", F.when(F.col("holders") == F.col("all"), F.col("low")).otherwise(0).alias("watermark"))


def report_have(cursors: DataFrame, own: DataFrame) -> DataFrame:
    """A device's report: the highest counter per source, its own writes included, zeros left out."""
    marks = cursors.select("replica", "counter").union(own.select("replica", "counter"))
    return marks.groupBy("replica").agg(F.max("counter").alias("mark")).where(F.col("mark") > 0)


def stale_sources(produced: DataFrame, cursors: DataFrame) -> DataFrame:
    """Sources that peers say wrote more than we were served."""
    joined = produced.join(cursors.select("replica", F.col("counter").alias("_served")), "replica", "left")
    return joined.where(F.col("counter") > F.coalesce("_served", F.lit(0))).select("replica", "counter", F.coalesce("_served", F.lit(0)).alias("served"))


def last_id(counter: Column, kind: Column, length: Column, count: Column) -> Column:
    """The last id that an operation consumes; the one before its own where it consumes none."""
    return counter + op_span(kind, length, count) - 1


def op_span(kind: Column, length: Column, count: Column) -> Column:
    """Ids that an operation consumes: one per character or per deleted character."""
    return F.when(kind == "insert", length).otherwise(count)


def pieces(segments: DataFrame, size: int = PIECE) -> DataFrame:
    """``segments(segment, bytes)`` cut into transfer pieces ``offset, length``."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))
    cut = segments.where("bytes > 0").select("segment", "bytes", F.explode(starts).alias("offset"))
    return cut.withColumn("length", F.least(F.lit(size), F.col("bytes") - F.col("offset")).cast("long"))


def reassembled(parts: DataFrame) -> DataFrame:
    """Segments whose pieces follow one another from 0 and add up to the total."""
    order = Window.partitionBy("segment").orderBy("offset")
    expected = F.coalesce(F.lag(F.col("offset") + F.col("length")).over(order), F.lit(0))
    seen = parts.withColumn("_whole", F.col("offset") == expected)
    return seen.groupBy("segment").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("bytes"),
        (F.every("_whole") & (F.sum("length") == F.max("bytes")) & (F.min("bytes") == F.max("bytes"))).alias("complete"),
    )
