"""What a relay keeps: pushes, reports and pieces in keyed tables, an outbox that is drained into one, and what a fetch counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans import log_queries, state_queries
from marginalia.session import table
from marginalia.sources import keyed
from marginalia.sources.outbox import Outbox
from marginalia.streaming import fetching

PIECE, BUCKETS = 1000, 16


def sink_relay_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of operations pushed twice: every other one first, then all, and those that divide by 5 with other bytes."""
    ops = log_queries.ops(spark, sf_dir).select("object", "replica", "counter", F.concat("object", F.lit("#"), "counter").alias("payload"))
    again = ops.withColumn("payload", F.when(F.col("counter") % 5 == 0, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    path, keys = state_queries.new_folder(spark), ["object", "replica", "counter"]
    keyed.merge(ops.where("counter % 2 = 0"), path, keys, 0, buckets=BUCKETS)
    keyed.merge(again, path, keys, 1, buckets=BUCKETS)
    return keyed.read(spark, path)


def sink_relay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each device, of a stream that brings them in no order."""
    reports = table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("clock"), F.col("event_type").alias("body"))
    base = state_queries.new_folder(spark)
    reports.repartition(state_queries.FILES).write.parquet(f"{base}/in")
    writer = state_queries.files_of(reports, f"{base}/in").writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)

    def keep(rows: DataFrame, n: int) -> None:
        keyed.merge(rows, f"{base}/table", ["device"], n, newest=["clock"], buckets=BUCKETS)

    writer.foreachBatch(keep).start().awaitTermination()
    return keyed.read(spark, f"{base}/table")


def sink_relay_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and bytes that are kept of each segment: every third piece comes twice, with the second half of all."""
    pieces, path = log_queries.transfer_pieces(spark, sf_dir), state_queries.new_folder(spark)
    part = F.floor(F.col("offset") / PIECE) % 2
    keyed.merge(pieces.where(part == 0), path, ["segment", "offset"], 0, buckets=BUCKETS)
    keyed.merge(pieces.where((part == 1) | (F.col("offset") / PIECE % 3 == 0)), path, ["segment", "offset"], 1, buckets=BUCKETS)
    return keyed.read(spark, path).groupBy("segment").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("bytes"))


def st_pending_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest operations out of an outbox, by a drain that stops after it handed over its second claim and one that goes on."""
    ops = log_queries.manifest_ops(spark, sf_dir).select("counter", "replica", "kind", "segment")
    base, keys = state_queries.new_folder(spark), ["counter", "replica"]
    page = max(1, -(-ops.dropDuplicates(keys).count() // 3))
    box = Outbox(spark, f"{base}/outbox", keys, page)
    box.put(ops)
    deliver = lambda rows, n: keyed.merge(rows, f"{base}/log", keys, n, buckets=BUCKETS)
    for acknowledged in (True, False):
        claimed = box.claim()
        if claimed is None:
            return ops.limit(0).withColumn("left_behind", F.lit(False))
        deliver(claimed[1], claimed[0])
        if acknowledged:
            box.acknowledge(claimed[0])
    box.drain(deliver)
    left = box.pending().withColumn("left_behind", F.lit(True))
    sent = keyed.read(spark, f"{base}/log").withColumn("left_behind", F.lit(False))
    return sent.unionByName(left.select(*sent.columns))


def agg_fetch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per object what a stream fetched, with every third operation delivered twice, and what of it was new: as the stream observed it."""
    rows, base = log_queries.ops(spark, sf_dir).select("object", "replica", "counter"), state_queries.new_folder(spark)
    rows.unionByName(rows.where("counter % 3 = 0")).repartition(state_queries.FILES).write.parquet(f"{base}/in")
    objects = [r.object for r in rows.select("object").distinct().orderBy("object").collect()]
    stats = fetching.fetched(state_queries.files_of(rows, f"{base}/in"), objects, f"{base}/state", f"{base}/out")
    return spark.createDataFrame([(s.object, s.fetched, s.applied, s.repeats, s.cursor_after) for s in stats], "object string, fetched long, applied long, repeats long, cursor_after long")


QUERIES = {f.__name__: f for f in (sink_relay_push, sink_relay_report, sink_relay_piece, st_pending_outbox, agg_fetch_stats)}
ORACLES = {
    "sink_relay_push": """
SELECT event_type AS object, user_id AS replica, event_id AS counter, event_type || '#' || event_id || CASE WHEN event_id % 10 = 5 THEN '!' ELSE '' END AS payload FROM events""",
    "sink_relay_report": "SELECT user_id AS device, max(event_id) AS clock, arg_max(event_type, event_id) AS body FROM events GROUP BY 1",
    "sink_relay_piece": f"""
SELECT doc_id AS segment, (strlen(text) + {PIECE - 1}) // {PIECE} AS pieces, strlen(text)::BIGINT AS bytes FROM documents WHERE strlen(text) > 0""",
    "st_pending_outbox": log_queries.SLOTS + """
SELECT segment * 100 + 1 AS counter, 'a' AS replica, 'add' AS kind, segment, false AS left_behind FROM s
UNION ALL SELECT segment * 100 + 10 + slot, 'b', 'tombstone', segment, false FROM e WHERE dead
UNION ALL SELECT segment * 100 + 50, 'c', 'retire', segment, false FROM s WHERE heir IS NOT NULL""",
    "agg_fetch_stats": """
SELECT event_type AS object, (count(*) + count(*) FILTER (event_id % 3 = 0))::BIGINT AS fetched, count(*) AS applied, count(*) FILTER (event_id % 3 = 0) AS repeats, max(event_id) AS cursor_after
FROM events GROUP BY 1""",
}
