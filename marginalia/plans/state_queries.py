"""Streams that look back, over the driver tables: laid down as files in no order, streamed to their end, and read.

Orders are moves: each puts a customer under another of the same vault, thirty customers a
vault. Events are text operations of several writers: an event's text hangs on that of
another event of its note, and some events never come.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.plans import log_queries
from marginalia.session import shared_dir, stored, table
from marginalia.streaming import stateful

FILES, VAULT = 3, 30
#: Logical time that an operation and its segment may be apart, and rows of a stream that come at a time.
HORIZON, RANGE = 100, 2_000_000


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}"


def files_of(rows: DataFrame, path: str, per_trigger: int | None = 1) -> DataFrame:
    """The files under ``path`` as a stream with the columns of ``rows``; without ``per_trigger`` all that are there at a time."""
    reader = rows.sparkSession.readStream.schema(rows.schema)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(path)


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third order puts its customer below the root, the others under a customer of the same vault."""
    vault, child = F.floor(F.col("o_custkey") / VAULT), F.col("o_custkey")
    under = vault * VAULT + F.col("o_orderkey") * 7 % VAULT
    named = lambda c: F.concat(F.lit("c"), c.cast("string"))
    return table(spark, sf_dir, "orders").select(
        vault.cast("string").alias("vault"), F.col("o_orderkey").alias("counter"), F.lit("a").alias("replica"), named(child).alias("child"),
        F.when(F.col("o_orderkey") % 3 == 0, "root").otherwise(named(under)).alias("parent"), F.concat(F.lit("f"), child.cast("string")).alias("name"), F.lit(True).alias("is_dir"),
    )


def st_late_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where moves that come in no order leave each node."""
    rows, base = moves(spark, sf_dir), new_folder(spark)
    rows.repartition(FILES).write.parquet(f"{base}/in")
    stateful.run(stateful.replayed(files_of(rows, f"{base}/in")), f"{base}/state", f"{base}/out")
    return stateful.latest(spark.read.parquet(f"{base}/out")).select("vault", "child", "parent")


def note_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user are a note: the i-th hangs on the last character of number i / 2, every fifth deletes the text of number i / 3."""
    ids = "struct<counter:bigint,replica:string>"
    order = Window.partitionBy("object").orderBy("n")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("object"), F.col("event_id").alias("n"), "event_type")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("counter", F.col("n") * 100 + 1).withColumn("size", F.length("event_type"))
    causes = rows.select("object", F.col("i").alias("_i"), F.col("counter").alias("_counter"), F.col("event_type").alias("_writer"), F.col("size").alias("_size"))
    above = lambda k: rows.withColumn("_i", F.floor(F.col("i") / k).cast("int")).join(causes, ["object", "_i"], "left")
    codes = F.filter(F.transform(F.split("event_type", ""), lambda c: F.ascii(c)), lambda c: c > 0)
    inserts = above(2).select(
        "object", "counter", F.col("event_type").alias("replica"), F.lit("insert").alias("kind"),
        F.when(F.col("_counter").isNotNull(), F.struct((F.col("_counter") + F.col("_size") - 1).alias("counter"), F.col("_writer").alias("replica"))).alias("parent"),
        F.lit("right").alias("side"), codes.alias("text"), F.lit(None).cast(ids).alias("target"), F.lit(None).cast("int").alias("count"), "n",
    )
    deletes = above(3).where("n % 5 = 0 AND _counter IS NOT NULL").select(
        "object", (F.col("counter") + 50).alias("counter"), F.col("event_type").alias("replica"), F.lit("delete").alias("kind"), F.lit(None).cast(ids).alias("parent"),
        F.lit(None).cast("string").alias("side"), F.lit(None).cast("array<int>").alias("text"), F.struct(F.col("_counter").alias("counter"), F.col("_writer").alias("replica")).alias("target"), F.col("_size").cast("int").alias("count"), "n",
    )
    return inserts.unionByName(deletes)


def arrived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations that come: not those of every 97th event."""
    return note_ops(spark, sf_dir).where("n % 97 <> 0").drop("n")


def st_late_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation that came, and whether all it needs has come as well; those that wait are read from the state."""
    rows, base = stateful.text_causes(arrived(spark, sf_dir)), new_folder(spark)
    rows.repartition(FILES).write.parquet(f"{base}/in")
    stateful.run(stateful.causal(files_of(rows, f"{base}/in")), f"{base}/state", f"{base}/out")
    ids = ["object", "counter", "replica"]
    through = spark.read.parquet(f"{base}/out").select(*ids, F.lit(True).alias("closed"))
    return through.unionByName(stateful.still_waiting(spark, f"{base}/state").select(*ids, F.lit(False).alias("closed")))


def st_watermark_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's log keeps once all event types have reported how far they hold it, also after everything came again."""
    rows, base = log_queries.ops(spark, sf_dir).select("object", F.col("replica").cast("string").alias("replica"), "counter"), new_folder(spark)
    reports = rows.groupBy("object", "replica").agg(F.max("counter").alias("counter")).withColumnRenamed("object", "reader")
    # the devices that take part
    readers = [r.object for r in rows.select("object").distinct().orderBy("object").collect()]
    rows.limit(0).write.parquet(f"{base}/ops")
    reports.limit(0).write.parquet(f"{base}/reports")
    phases = [(rows.repartition(FILES), "ops"), (reports.repartition(FILES), "reports"), (rows.repartition(FILES), "ops")]
    for now, name in phases:
        now.write.mode("append").parquet(f"{base}/{name}")
        stream = stateful.shrinking(files_of(rows, f"{base}/ops"), files_of(reports, f"{base}/reports"), readers)
        stateful.run(stream, f"{base}/state", f"{base}/out")
    return stateful.kept_log(spark, f"{base}/state").select("object", F.col("replica").cast("long").alias("replica"), "counter")


def counter_ranges(rows: DataFrame, n: int) -> list[Column]:
    """Conditions that deal rows to ``n`` ranges of the counters of ``rows``, or to fewer where these repeat."""
    inner = rows.approxQuantile("counter", [i / n for i in range(1, n)], 0.01 / n)
    edges, at = [None, *map(int, sorted(set(inner))), None], F.col("counter")
    above = [F.lit(True) if low is None else at >= low for low in edges[:-1]]
    return [low if high is None else low & (at < high) for low, high in zip(above, edges[1:])]


def by_counter(rows: DataFrame, path: str) -> None:
    """``rows`` as FILES files by ranges of their counter, and what closes them."""
    for within in counter_ranges(rows, FILES):
        rows.where(within).write.mode("append").parquet(path)
    close(rows, path)


def close(rows: DataFrame, path: str, ahead: int = 50) -> None:
    """Two rows of no segment far behind all of ``rows``: a stream's time moves on only with what comes."""
    last = rows.agg(F.max("counter").alias("counter")).where("counter IS NOT NULL")
    for k in (ahead, 2 * ahead):
        row = last.select(*[(F.col("counter") + k * HORIZON if c == "counter" else F.lit(None).cast(t)).alias(c) for c, t in rows.dtypes])
        row.coalesce(1).write.mode("append").parquet(path)


def wanted_streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manifest operations, and segments that come a little before or after them; those that divide by 9 come far too late."""
    ops = log_queries.manifest_ops(spark, sf_dir).select("counter", "replica", "kind", "segment")
    away = F.when(F.col("segment") % 9 == 0, 40 * HORIZON).otherwise((F.col("segment") % 3 - 1) * 40)
    came = log_queries.present(spark, sf_dir).select("segment", (F.col("segment") * 100 + 30 + away).alias("counter"))
    return ops, came.unionByName(came.where("segment % 4 = 0"))


def st_wanted_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each manifest operation, and whether its segment came in time."""
    base, names = new_folder(spark), ("ops", "came")
    held = {name: stored(rows.repartitionByRange("counter")) for name, rows in zip(names, wanted_streams(spark, sf_dir))}
    for name, rows in held.items():
        rows.limit(0).write.parquet(f"{base}/{name}")
    ranges = counter_ranges(held["ops"], max(FILES, -(-held["ops"].count() // RANGE)))
    # rows of a range are in no order: all of its files come at a time, or those that come first make the others late
    for k, within in enumerate(ranges):
        for name, rows in held.items():
            rows.where(within).write.mode("append").parquet(f"{base}/{name}")
            if k + 1 == len(ranges):
                close(rows, f"{base}/{name}")
        stateful.run(stateful.wanted(*[files_of(held[name], f"{base}/{name}", None) for name in names], HORIZON), f"{base}/state", f"{base}/out", processors=False)
    return spark.read.parquet(f"{base}/out").where("segment IS NOT NULL").select("counter", "replica", "kind", "segment", "here")


QUERIES = {f.__name__: f for f in (st_late_replay, st_late_buffer, st_watermark_compact, st_wanted_memory)}

#: The fold, one step of a walk up from a move's parent at a time: places holds the parent of each of a vault's nodes, 0 is the root.
FOLD = f"""
WITH RECURSIVE o AS (
  SELECT o_custkey // {VAULT} AS vault, o_orderkey AS counter, o_custkey % {VAULT} + 1 AS child,
         CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey * 7 % {VAULT} + 1 END AS parent FROM orders),
m AS (SELECT vault, child, parent, row_number() OVER (PARTITION BY vault ORDER BY counter) AS i FROM o WHERE child <> parent),
n AS (SELECT vault, count(*) AS moves FROM m GROUP BY vault),
w AS (
  SELECT vault, 1::BIGINT AS i, NULL::BIGINT AS at, list_transform(range({VAULT} + 1), lambda x: NULL::BIGINT) AS places FROM n
  UNION ALL
  SELECT vault, CASE WHEN up IS NULL THEN i + 1 ELSE i END, up,
         CASE WHEN up IS NULL AND here <> child THEN list_transform(places, lambda p, k: CASE WHEN k = child THEN parent ELSE p END) ELSE places END
  FROM (SELECT w.vault, w.i, m.child, m.parent, places, coalesce(w.at, m.parent) AS here,
               CASE WHEN coalesce(w.at, m.parent) IN (0, m.child) THEN NULL ELSE places[coalesce(w.at, m.parent)::INT] END AS up
        FROM w JOIN m ON m.vault = w.vault AND m.i = w.i)),
f AS (SELECT w.vault, unnest(range(1, {VAULT} + 1)) AS child, unnest(places[1:{VAULT}]) AS parent FROM w JOIN n ON n.vault = w.vault AND w.i = n.moves + 1)
SELECT vault::VARCHAR AS vault, 'c' || (vault * {VAULT} + child - 1) AS child, CASE WHEN parent = 0 THEN 'root' ELSE 'c' || (vault * {VAULT} + parent - 1) END AS parent
FROM f WHERE parent IS NOT NULL"""

ORACLES = {
    "st_late_replay": FOLD,
    "st_late_buffer": """
WITH RECURSIVE e AS (
  SELECT user_id::VARCHAR AS object, event_id AS n, event_type AS replica, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (
  SELECT object, i FROM e WHERE i = 1 AND n % 97 <> 0
  UNION ALL
  SELECT e.object, e.i FROM c JOIN e ON e.object = c.object AND e.i // 2 = c.i AND e.n % 97 <> 0),
o AS (
  SELECT object, n * 100 + 1 AS counter, replica, i AS cause FROM e WHERE n % 97 <> 0
  UNION ALL
  SELECT object, n * 100 + 51, replica, i // 3 FROM e WHERE n % 97 <> 0 AND n % 5 = 0 AND i >= 3)
SELECT o.object, counter, replica, c.i IS NOT NULL AS closed FROM o LEFT JOIN c ON c.object = o.object AND c.i = o.cause""",
    "st_watermark_compact": """
WITH t AS (SELECT user_id, event_type, max(event_id) AS top FROM events GROUP BY 1, 2),
m AS (SELECT user_id, CASE WHEN count(*) = (SELECT count(DISTINCT event_type) FROM events) THEN min(top) ELSE 0 END AS mark FROM t GROUP BY 1)
SELECT event_type AS object, e.user_id AS replica, event_id AS counter FROM events e JOIN m ON m.user_id = e.user_id WHERE event_id > mark""",
    "st_wanted_memory": log_queries.SLOTS + f"""
, a AS (SELECT segment, here AND segment % 9 <> 0 AS there, segment * 100 + 30 + (segment % 3 - 1) * 40 AS came_at FROM s),
o AS (
  SELECT segment * 100 + 1 AS counter, 'a' AS replica, 'add' AS kind, segment FROM s
  UNION ALL SELECT segment * 100 + 1, 'a', 'add', segment FROM s
  UNION ALL SELECT segment * 100 + 10 + slot, 'b', 'tombstone', segment FROM e WHERE dead
  UNION ALL SELECT segment * 100 + 50, 'c', 'retire', segment FROM s WHERE heir IS NOT NULL)
SELECT counter, replica, kind, o.segment, there AND abs(counter - came_at) <= {HORIZON} AS here FROM o JOIN a ON a.segment = o.segment""",
}
