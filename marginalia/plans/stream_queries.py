"""The streaming flows over the driver tables: a table is laid down as files, streamed to its end, and the result read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans import log_queries
from marginalia.session import shared_dir, table
from marginalia.streaming import flows

FILES = 3


def _drained(spark: SparkSession, rows: DataFrame, flow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``flow`` has written when all of ``rows`` went through it, a file at a time."""
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows.repartition(FILES).write.parquet(f"{base}/in")
    stream = flow(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(f"{base}/out")

    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    query = writer.foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def st_gap_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader may apply of a log with rows missing, in whatever order its files come."""
    rows = log_queries.served(spark, sf_dir).select("object", F.col("replica").cast("string").alias("replica"), "counter", "prev")
    return _drained(spark, rows, flows.gap_checked).select("object", F.col("replica").cast("long").alias("replica"), "counter")


def st_cursor_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages delivered twice and applied once."""
    rows = log_queries.ops(spark, sf_dir).select("object", "replica", "counter")
    base = f"{shared_dir(spark).rstrip('/')}/fetch-{uuid.uuid4().hex}"
    rows.repartition(FILES).write.parquet(f"{base}/in")
    apply = flows.apply_pages(f"{base}/applied", ["object", "replica", "counter"])

    def twice(page: DataFrame, n: int) -> None:
        apply(page, n)
        apply(page, n)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    return spark.read.parquet(f"{base}/applied")


def st_manifest_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of a stream of operations, each of them applied once.

    What was applied is kept as a table and not as state, which executors would hold for every
    operation there ever was; joins and folds of a table go to disk where they have to.
    """
    rows = log_queries.manifest_ops(spark, sf_dir).select(*flows.MANIFEST_ID, "segment", "kind", "count", "slot", "superseded_by")
    base = f"{shared_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    rows.repartition(FILES).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    writer.foreachBatch(flows.apply_pages(f"{base}/applied", flows.MANIFEST_ID)).start().awaitTermination()
    folded = flows.totals(spark.read.schema(rows.schema).parquet(f"{base}/applied"))
    return folded.select("segment", F.coalesce("count", F.lit(0)).alias("count"), "dead", "retired")


def _in_time_order(spark: SparkSession, rows: DataFrame, time: str, base: str) -> None:
    """``rows`` as FILES files, each of a range of times, written one after the other."""
    times = rows.select(F.unix_micros(time).alias("t"))
    inner = times.approxQuantile("t", [i / FILES for i in range(1, FILES)], 0.01)
    edges = [None, *map(int, sorted(set(inner))), None]
    for low, high in zip(edges, edges[1:]):
        t = F.unix_micros(time)
        part = rows if low is None else rows.where(t >= low)
        (part if high is None else part.where(t < high)).coalesce(1).write.mode("append").parquet(f"{base}/in")


def st_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as hints, flushed after six quiet hours or a day; what is pending at the end is flushed as well.

    The table is streamed in the order of time. After it come two hints of nobody, each
    far enough on for the watermark to pass all that is due.
    """
    quiet, most = 6 * 3600_000, 24 * 3600_000
    hints = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("vault"), F.col("event_type").alias("path"), (F.col("event_type") == "click").alias("renamed"), F.col("ts").cast("timestamp").alias("ts")
    )
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    _in_time_order(spark, hints, "ts", base)
    last = hints.agg(F.max("ts").alias("ts"))
    for days in (3, 6):
        nobody = last.where("ts IS NOT NULL").select(F.lit(None).cast("string").alias("vault"), F.lit("").alias("path"), F.lit(False).alias("renamed"), F.expr(f"ts + INTERVAL {days} DAYS").alias("ts"))
        nobody.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = flows.debounced(spark.readStream.schema(hints.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), quiet, most)
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").option("path", f"{base}/out")
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").where("vault IS NOT NULL")


QUERIES = {f.__name__: f for f in (st_gap_detect, st_cursor_fetch, st_manifest_fold, st_debounce)}
ORACLES = {
    "st_gap_detect": log_queries.ORACLES["win_chain_prefix"],
    "st_cursor_fetch": "SELECT event_type AS object, user_id AS replica, event_id AS counter FROM events",
    "st_debounce": """
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS vault, event_type AS path, event_type = 'click' AS renamed, epoch_us(ts) // 1000 AS t FROM events),
p AS (SELECT *, lag(t) OVER (PARTITION BY vault ORDER BY t) AS before FROM e),
q AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before >= 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY vault ORDER BY t) AS burst FROM p),
s AS (
  SELECT vault, burst, min(t) AS start FROM q GROUP BY vault, burst
  UNION ALL
  SELECT s.vault, s.burst, min(q.t) FROM s JOIN q ON q.vault = s.vault AND q.burst = s.burst AND q.t >= s.start + 86400000 GROUP BY s.vault, s.burst, s.start),
h AS (SELECT q.*, s.start FROM q ASOF JOIN s ON q.vault = s.vault AND q.burst = s.burst AND q.t >= s.start),
n AS (SELECT vault, start, least(max(t) + 21600000, start + 86400000) AS due FROM h GROUP BY vault, start)
SELECT h.vault, path, bool_or(renamed) AS renamed, max(due)::BIGINT AS flushed_at FROM h JOIN n USING (vault, start) GROUP BY h.vault, start, path""",
    "st_manifest_fold": log_queries.SLOTS + """
SELECT segment, (SELECT count(*) FROM e WHERE e.segment = s.segment) AS count, dead::INT AS dead, (segment % 7 = 0)::INT AS retired FROM s""",
}
