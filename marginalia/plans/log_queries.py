"""The operation log and the manifest over the driver tables.

``events`` is a log: object = event type, replica = user, counter = event id, and
``prev`` the source's counter before it. Where rows are to be missing, every 97th
event is. ``lineitem`` is an index: segment = order, slot = line number, dead where
any of its rows was returned; segment n is replaced by n + 1 where n divides by 7,
and not here where it divides by 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators import manifest, oplog
from marginalia.session import table


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("object"), F.col("user_id").alias("replica"), F.col("event_id").alias("counter"), "value", "ts"
    )
    return rows.withColumn("prev", F.lag("counter", 1, 0).over(oplog.chain()))


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops(spark, sf_dir).where("counter % 97 <> 0")


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader has applied: the accepted prefix of what it was served."""
    return oplog.high_water(oplog.accepted_prefix(served(spark, sf_dir))).withColumnRenamed("high", "counter")


def scan_oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops(spark, sf_dir).where("object = 'click'").select("object", "replica", "counter", "prev")


def scan_oplog_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.after(ops(spark, sf_dir), cursors(spark, sf_dir)).select("object", "replica", "counter")


def scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops(spark, sf_dir).select("object", "replica").distinct()


def scan_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.high_water(ops(spark, sf_dir))


def agg_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops(spark, sf_dir).groupBy("replica").agg(F.max("counter").alias("high"), F.count(F.lit(1)).alias("ops"))


def scan_blob_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops(spark, sf_dir).groupBy("object").agg(F.count(F.lit(1)).alias("blobs"))


def limit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.page(oplog.after(ops(spark, sf_dir), cursors(spark, sf_dir)), 5).select("object", "replica", "counter", F.col("place").cast("long").alias("place"), "more")


def win_chain_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.gaps(served(spark, sf_dir)).select("object", "replica", "counter", "gap")


def win_chain_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.accepted_prefix(served(spark, sf_dir)).select("object", "replica", "counter")


def win_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrival in three rounds, of every third event each."""
    order = Window.partitionBy("object", "replica").orderBy(F.col("counter") % 3, "counter")
    rows = ops(spark, sf_dir).withColumn("seq", F.row_number().over(order))
    return oplog.out_of_order(rows).select("object", "replica", "counter")


def win_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.last_write(ops(spark, sf_dir), "object", "value").select("object", "counter", "replica", F.round("value", 6).alias("value"))


def win_delete_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_id % 4 <> 0").select(
        F.lit("all").alias("object"), (F.col("event_id") % 2).alias("replica"), F.floor(F.col("event_id") / 2).alias("counter")
    )
    return oplog.coalesced_deletes(rows)


def set_union_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops(spark, sf_dir)
    both = rows.where("counter % 3 <> 0").unionByName(rows.where("counter % 2 = 0"))
    return oplog.distinct_ops(both).groupBy("object").agg(F.count(F.lit(1)).alias("ops"), F.sum("counter").alias("counters"))


def st_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops(spark, sf_dir)
    return oplog.distinct_ops(rows.unionByName(rows)).select("object", "replica", "counter")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten devices, each with the highest counter below its own bound of every source."""
    rows = ops(spark, sf_dir).select("replica", "counter")
    devices = spark.range(10).select(F.col("id").alias("device"), ((F.col("id") + 5) * 600).alias("clock"))
    held = devices.join(rows, F.col("counter") <= F.col("clock")).groupBy("device", "clock", "replica").agg(F.max("counter").alias("mark"))
    entries = F.map_from_entries(F.collect_list(F.struct("replica", "mark")))
    return held.groupBy("device", "clock").agg(entries.alias("have"))


def agg_compaction_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    produced = ops(spark, sf_dir).where("counter <= 3000").select("replica")
    return oplog.compaction_watermark(_reports(spark, sf_dir), spark.range(10).select(F.col("id").alias("device")), produced)


def agg_text_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ops(spark, sf_dir).select(F.col("object").alias("replica"), F.col("replica").alias("origin"), "counter")
    return oplog.text_watermark(held, held)


def agg_report_have(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ops(spark, sf_dir).where("replica % 10 = 0").groupBy("replica").agg(F.max("counter").alias("counter"))
    return oplog.report_have(cursors(spark, sf_dir), own)


def agg_stale_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    produced = ops(spark, sf_dir).groupBy("replica").agg(F.max("counter").alias("counter"))
    got = served(spark, sf_dir).groupBy("replica").agg(F.max("counter").alias("counter"))
    return oplog.stale_sources(produced, got)


def agg_prefix_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cursors(spark, sf_dir)


def transfer_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment"), F.octet_length("text").cast("long").alias("bytes"))
    return oplog.pieces(sizes, 1000)


def transfer_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = transfer_pieces(spark, sf_dir).where("NOT (segment % 6 = 0 AND offset = 1000)")
    return oplog.reassembled(parts)


def st_debounce_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events: a new one after six quiet hours."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    quiet = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order) >= 6 * 3600 * 1000000
    bursts = rows.withColumn("burst", F.sum(F.when(F.coalesce(quiet, F.lit(True)), 1).otherwise(0)).over(order))
    return bursts.groupBy("user_id", "burst").agg(F.count(F.lit(1)).alias("hints"), F.min("event_id").alias("first_id"), F.count_distinct("event_type").alias("paths"))


def st_hint_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.bool_or(F.col("event_type") == "click").alias("renamed"))


# ------------------------------------------------------------------ manifest


#: Rows of the index that a part of the manifest comes from.
PART_ROWS = 500_000


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many parts the manifest is dealt to, by the size of the index: as many as the session's, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // PART_ROWS))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("segment"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("object"), "l_returnflag"
    )


def dead_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).where("l_returnflag = 'R'").select("segment", "slot").distinct()


def live_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("segment", "slot").distinct()


def manifest_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds, tombstones and retirements of all orders, each with an id, and all adds twice."""
    none = lambda kind: F.lit(None).cast(kind)
    n = parts(spark, sf_dir)
    slots = manifest.dealt(entries(spark, sf_dir).select("segment", "slot"), ["segment"], n).distinct()
    counts = slots.groupBy("segment").agg(F.count(F.lit(1)).alias("count"))
    adds = counts.select(
        (F.col("segment") * 100 + 1).alias("counter"), F.lit("a").alias("replica"), F.lit("add").alias("kind"), "segment", "count", (F.col("count") * 256).alias("bytes"),
        F.when(F.col("segment") % 11 == 0, "other").otherwise("own").alias("model"), none("int").alias("slot"), none("bigint").alias("superseded_by"),
    )
    dead = manifest.dealt(entries(spark, sf_dir).where("l_returnflag = 'R'").select("segment", "slot"), ["segment"], n).distinct()
    tombs = dead.select(
        (F.col("segment") * 100 + 10 + F.col("slot")).alias("counter"), F.lit("b").alias("replica"), F.lit("tombstone").alias("kind"), "segment",
        none("bigint").alias("count"), none("bigint").alias("bytes"), none("string").alias("model"), "slot", none("bigint").alias("superseded_by"),
    )
    retires = counts.where("segment % 7 = 0").select(
        (F.col("segment") * 100 + 50).alias("counter"), F.lit("c").alias("replica"), F.lit("retire").alias("kind"), "segment",
        none("bigint").alias("count"), none("bigint").alias("bytes"), none("string").alias("model"), none("int").alias("slot"), (F.col("segment") + 1).alias("superseded_by"),
    )
    return adds.unionByName(adds).unionByName(tombs).unionByName(retires)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.fold(manifest_ops(spark, sf_dir), F.lit("own"), parts(spark, sf_dir))


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).select("segment").where("segment % 5 <> 0")
    return manifest.dealt(rows, ["segment"], parts(spark, sf_dir)).distinct()


def agg_manifest_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return state(spark, sf_dir).fillna(0, ["count", "bytes"]).select("segment", "count", "bytes", text("dead"), text("superseded_by"))


def agg_manifest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.counters(manifest_ops(spark, sf_dir), F.lit("own"), parts(spark, sf_dir))


def _set(f):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(state(spark, sf_dir), present(spark, sf_dir))

    return query


def sort_fetch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.fetch_order(state(spark, sf_dir), present(spark, sf_dir))


def agg_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = entries(spark, sf_dir).groupBy("segment", "slot").agg(F.min("object").alias("object"))
    return manifest.index_stats(slots, dead_slots(spark, sf_dir))


def flt_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.live_entries(live_slots(spark, sf_dir), dead_slots(spark, sf_dir))


def flt_all_dead_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state(spark, sf_dir)
    return rows.where(F.col("count") > F.size("dead")).select("segment", "count", F.size("dead").cast("long").alias("dead"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of many sizes: one per supplier, slots are its lines."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("segment"), "l_returnflag")
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("l_returnflag") == "R").alias("dead"))


def idx_plan_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.plan_compaction(_sizes(spark, sf_dir), 8, 20, tier_ratio=1).union(
        manifest.plan_compaction(_sizes(spark, sf_dir).where("segment % 10 = 0"), 1000, 20)
    )


def agg_compaction_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    percent = F.floor(F.col("dead") * 100 / F.col("count")).cast("long")
    return _sizes(spark, sf_dir).select("segment", (F.col("count") - F.col("dead")).alias("live"), "dead", percent.alias("dead_percent"))


OPS = """
WITH o AS (SELECT event_type AS object, user_id AS replica, event_id AS counter, value, ts,
                  lag(event_id, 1, 0) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS prev FROM events),
v AS (SELECT * FROM o WHERE counter % 97 <> 0),
g AS (SELECT *, lag(counter, 1, 0) OVER (PARTITION BY object, replica ORDER BY counter) <> prev AS gap FROM v),
a AS (SELECT *, sum(gap::INT) OVER (PARTITION BY object, replica ORDER BY counter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gaps FROM g),
c AS (SELECT object, replica, max(counter) AS counter FROM a WHERE gaps = 0 GROUP BY object, replica),
n AS (SELECT o.* FROM o LEFT JOIN c USING (object, replica) WHERE o.counter > coalesce(c.counter, 0))
"""
SLOTS = """
WITH e AS (SELECT l_orderkey AS segment, l_linenumber AS slot, min(l_partkey) AS object, bool_or(l_returnflag = 'R') AS dead FROM lineitem GROUP BY 1, 2),
s AS (SELECT segment, CASE WHEN segment % 11 <> 0 THEN count(*) END AS count, count(*) FILTER (dead) AS dead,
             coalesce(string_agg(slot::VARCHAR, ',' ORDER BY slot) FILTER (dead), '') AS slots,
             CASE WHEN segment % 7 = 0 THEN segment + 1 END AS heir, segment % 5 <> 0 AS here FROM e GROUP BY segment),
st AS (SELECT * FROM s WHERE count IS NOT NULL OR dead > 0 OR heir IS NOT NULL),
p AS (SELECT st.*, heir IS NOT NULL AND EXISTS (SELECT 1 FROM s t WHERE t.segment = st.heir AND t.here) AS replaced FROM st)
"""
SIZES = "WITH z AS (SELECT l_suppkey AS segment, count(*) AS count, count(*) FILTER (l_returnflag = 'R') AS dead FROM lineitem GROUP BY 1)"

QUERIES = {
    f.__name__: f
    for f in (
        scan_oplog, scan_oplog_after, scan_sources, scan_high_water, agg_high_water, scan_blob_count, limit_page, win_chain_gap, win_chain_prefix,
        win_out_of_order, win_last_write, win_delete_coalesce, set_union_ops, st_dedup, agg_compaction_watermark, agg_text_watermark,
        agg_report_have, agg_stale_relay, agg_prefix_mark, transfer_pieces, transfer_complete, st_debounce_batch, st_hint_coalesce,
        agg_manifest_fold, agg_manifest_counters, sort_fetch_order, agg_index_stats, flt_live, flt_all_dead_segment, idx_plan_compaction, agg_compaction_cost,
    )
} | {"set_live": _set(manifest.live), "set_missing": _set(manifest.missing), "set_droppable": _set(manifest.droppable), "set_awaiting": _set(manifest.awaiting)}
ORACLES = {
    "scan_oplog": OPS + "SELECT object, replica, counter, prev FROM o WHERE object = 'click'",
    "scan_oplog_after": OPS + "SELECT object, replica, counter FROM n",
    "scan_sources": "SELECT DISTINCT event_type AS object, user_id AS replica FROM events",
    "scan_high_water": "SELECT event_type AS object, user_id AS replica, max(event_id) AS high FROM events GROUP BY 1, 2",
    "agg_high_water": "SELECT user_id AS replica, max(event_id) AS high, count(*) AS ops FROM events GROUP BY 1",
    "scan_blob_count": "SELECT event_type AS object, count(*) AS blobs FROM events GROUP BY 1",
    "limit_page": OPS + """
SELECT object, replica, counter, place, total > 5 AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY object, replica ORDER BY counter) AS place, count(*) OVER (PARTITION BY object, replica) AS total FROM n) WHERE place <= 5""",
    "win_chain_gap": OPS + "SELECT object, replica, counter, gap FROM g",
    "win_chain_prefix": OPS + "SELECT object, replica, counter FROM a WHERE gaps = 0",
    "win_out_of_order": """
SELECT object, replica, counter FROM (
  SELECT event_type AS object, user_id AS replica, event_id AS counter,
         max(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id % 3, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events)
WHERE counter <= high""",
    "win_last_write": """
SELECT object, counter, replica, round(value, 6) AS value FROM (
  SELECT event_type AS object, event_id AS counter, user_id AS replica, value,
         row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC, user_id DESC) AS n FROM events) WHERE n = 1""",
    "win_delete_coalesce": """
WITH d AS (SELECT DISTINCT event_id % 2 AS replica, event_id // 2 AS counter FROM events WHERE event_id % 4 <> 0),
i AS (SELECT *, counter - row_number() OVER (PARTITION BY replica ORDER BY counter) AS island FROM d)
SELECT 'all' AS object, replica, min(counter) AS counter, count(*) AS count FROM i GROUP BY replica, island""",
    "set_union_ops": """
SELECT event_type AS object, count(*) AS ops, sum(event_id)::BIGINT AS counters FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0 GROUP BY 1""",
    "st_dedup": "SELECT event_type AS object, user_id AS replica, event_id AS counter FROM events",
    "agg_compaction_watermark": """
WITH d AS (SELECT range AS device, (range + 5) * 600 AS clock FROM range(10)),
r AS (SELECT device, clock, user_id AS replica, max(event_id) AS mark FROM d JOIN events ON event_id <= clock GROUP BY 1, 2, 3),
p AS (SELECT DISTINCT user_id AS replica FROM events WHERE event_id <= 3000),
k AS (SELECT DISTINCT device, clock FROM r)
SELECT CASE WHEN (SELECT count(*) FROM k) < 10 THEN 0 ELSE least((SELECT min(clock) FROM k),
  (SELECT min(coalesce(r.mark, 0)) FROM k CROSS JOIN p LEFT JOIN r ON r.device = k.device AND r.replica = p.replica)) END::BIGINT AS watermark""",
    "agg_text_watermark": """
WITH h AS (SELECT event_type AS replica, user_id AS origin, max(event_id) AS top FROM events GROUP BY 1, 2),
x AS (SELECT r.replica, o.origin FROM (SELECT DISTINCT replica FROM h) r CROSS JOIN (SELECT DISTINCT origin FROM h) o)
SELECT x.origin, min(coalesce(h.top, 0)) AS watermark FROM x LEFT JOIN h ON h.replica = x.replica AND h.origin = x.origin GROUP BY x.origin""",
    "agg_report_have": OPS + """
SELECT replica, max(counter) AS mark FROM (
  SELECT replica, counter FROM c UNION ALL SELECT user_id, max(event_id) FROM events WHERE user_id % 10 = 0 GROUP BY 1) GROUP BY replica HAVING max(counter) > 0""",
    "agg_stale_relay": """
SELECT p.replica, p.counter, coalesce(s.counter, 0) AS served FROM (SELECT user_id AS replica, max(event_id) AS counter FROM events GROUP BY 1) p
LEFT JOIN (SELECT user_id AS replica, max(event_id) AS counter FROM events WHERE event_id % 97 <> 0 GROUP BY 1) s USING (replica)
WHERE p.counter > coalesce(s.counter, 0)""",
    "agg_prefix_mark": OPS + "SELECT object, replica, counter FROM c",
    "transfer_pieces": """
WITH d AS (SELECT doc_id AS segment, strlen(text) AS bytes FROM documents WHERE strlen(text) > 0),
o AS (SELECT *, unnest(range(0, bytes, 1000)) AS "offset" FROM d)
SELECT segment, bytes, "offset", least(1000, bytes - "offset") AS length FROM o""",
    "transfer_complete": """
WITH d AS (SELECT doc_id AS segment, strlen(text) AS bytes FROM documents WHERE strlen(text) > 0)
SELECT segment, ceil(bytes / 1000.0)::BIGINT - lost AS pieces, bytes - lost * least(1000, bytes - 1000) AS bytes, lost = 0 AS complete
FROM (SELECT *, CASE WHEN segment % 6 = 0 AND bytes > 1000 THEN 1 ELSE 0 END AS lost FROM d)""",
    "st_debounce_batch": """
WITH l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quiet FROM events),
b AS (SELECT *, sum(CASE WHEN quiet IS NULL OR quiet >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM l)
SELECT user_id, burst::BIGINT AS burst, count(*) AS hints, min(event_id) AS first_id, count(DISTINCT event_type) AS paths FROM b GROUP BY 1, 2""",
    "st_hint_coalesce": "SELECT user_id AS path, bool_or(event_type = 'click') AS renamed FROM events GROUP BY 1",
    "agg_manifest_fold": SLOTS + "SELECT segment, coalesce(count, 0) AS count, coalesce(count * 256, 0) AS bytes, slots AS dead, coalesce(heir::VARCHAR, '') AS superseded_by FROM st",
    "agg_manifest_counters": SLOTS + """
SELECT (SELECT count(*) FROM s) + (SELECT count(*) FROM e WHERE dead) + (SELECT count(*) FROM s WHERE segment % 7 = 0) AS applied,
       (SELECT count(*) FROM s) AS duplicate, (SELECT count(*) FROM s WHERE segment % 11 = 0) AS refused_model""",
    "sort_fetch_order": SLOTS + """
SELECT segment, heir IS NOT NULL AS replaced, row_number() OVER (ORDER BY heir IS NOT NULL, segment) AS place FROM p WHERE count > 0 AND NOT here""",
    "set_live": SLOTS + "SELECT segment FROM p WHERE here AND NOT replaced",
    "set_missing": SLOTS + "SELECT segment FROM p WHERE count > 0 AND NOT here AND NOT replaced",
    "set_droppable": SLOTS + "SELECT segment FROM p WHERE here AND replaced",
    "set_awaiting": SLOTS + "SELECT segment FROM p WHERE here AND heir IS NOT NULL AND NOT replaced",
    "agg_index_stats": SLOTS + """
SELECT count(DISTINCT segment) AS segments, count(*) AS vectors, count(*) FILTER (dead) AS tombstoned, count(DISTINCT object) FILTER (NOT dead) AS objects FROM e""",
    "flt_live": SLOTS + "SELECT segment, slot FROM e WHERE NOT dead",
    "flt_all_dead_segment": SLOTS + "SELECT segment, count, dead FROM st WHERE count > dead",
    "idx_plan_compaction": SIZES + """
, a AS (SELECT *, min(count) OVER () AS least FROM z), b AS (SELECT *, min(count) OVER () AS least FROM z WHERE segment % 10 = 0),
x AS (SELECT *, count(*) OVER () AS n, sum(count) OVER () AS every, sum(dead) OVER () AS gone FROM a WHERE count <= least),
y AS (SELECT *, count(*) OVER () AS n, sum(count) OVER () AS every, sum(dead) OVER () AS gone FROM b WHERE count <= 4 * least)
SELECT segment, count, dead, CASE WHEN n >= 8 THEN 'segment count' ELSE 'dead ratio' END AS reason FROM x WHERE n >= 2 AND (n >= 8 OR floor(gone * 100 / every) >= 20)
UNION ALL
SELECT segment, count, dead, CASE WHEN n >= 1000 THEN 'segment count' ELSE 'dead ratio' END FROM y WHERE n >= 2 AND (n >= 1000 OR floor(gone * 100 / every) >= 20)""",
    "agg_compaction_cost": SIZES + "SELECT segment, count - dead AS live, dead, (dead * 100 // count) AS dead_percent FROM z",
}
