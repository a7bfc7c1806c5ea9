"""Records, sinks, pages of listings, generated edits and sealed texts over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import records, vectors
from marginalia.operators import manifest, search, segments, text_crdt, topics, tree
from marginalia.plans import log_queries, search_queries, text_queries
from marginalia.session import numbered, shared_dir, table
from marginalia.sources import notes, sinks

KEY = b"0123456789abcdef"  # of these examples


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/records-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ scans and pages


def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries._nodes(spark, sf_dir).select("child", "parent", "name")


def scan_index_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live slots, each with its place in its segment."""
    live = manifest.live_entries(log_queries.live_slots(spark, sf_dir), log_queries.dead_slots(spark, sf_dir))
    return live.select("segment", "slot", F.row_number().over(Window.partitionBy("segment").orderBy("slot")).cast("long").alias("place"))


def scan_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose entries still have the digest that was stored; every ninth was tampered with."""
    slots = F.array_join(F.array_sort(F.collect_list("slot")).cast("array<string>"), ",")
    held = log_queries.live_slots(spark, sf_dir).groupBy("segment").agg(slots.alias("slots"))
    stored = held.select("segment", F.sha2(F.concat("slots", F.when(F.col("segment") % 9 == 0, "x").otherwise("")), 256).alias("digest"))
    return held.join(stored, "segment").where(F.sha2("slots", 256) == F.col("digest")).select("segment", "slots")


def scan_relay_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifty operations of each object past a cursor, and whether more follow."""
    order = Window.partitionBy("object").orderBy("counter", "replica")
    rows = log_queries.ops(spark, sf_dir).where("counter > 1000").select("object", "counter", "replica", F.row_number().over(order).cast("long").alias("place"))
    page = rows.where("place <= 51")
    more = page.groupBy("object").agg((F.max("place") > 50).alias("more"))
    return page.where("place <= 50").join(more, "object")


def scan_relay_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three reports of every vault."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("place"))
    return rows.where("place <= 3")


def scan_relay_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each segment the first piece at or after byte 1,500."""
    parts = log_queries.transfer_pieces(spark, sf_dir).where("offset >= 1500")
    first = parts.groupBy("segment").agg(F.min(F.struct("offset", "length")).alias("p"))
    return first.select("segment", "p.offset", "p.length")


def limit_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of 4,096 segments after a given one."""
    after = log_queries.live_slots(spark, sf_dir).select("segment").where("segment > 1000").distinct()
    return after.orderBy("segment").limit(4096)


def limit_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey").limit(256)


def scan_eval_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question file of benchmark items: a third are comments, and a third must be refused."""
    n = F.col("item_id")
    line = F.when(n % 3 == 0, F.concat(F.lit("# item "), n)).when(n % 3 == 1, F.concat(F.lit("what is "), n, F.lit("\tNONE")))
    base = _folder(spark)
    table(spark, sf_dir, "benchmark").select(F.coalesce(line, F.concat(F.lit("what is \""), n, F.lit("\titem "), n)).alias("value")).write.text(base)
    return notes.questions(spark, base).select("question", F.coalesce("expected", F.lit("-")).alias("expected"))


def sort_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.paths(text_queries._nodes(spark, sf_dir))
    return numbered(rows, ["path", "child"], within=("vault",)).select("path", "child", "place")


# ------------------------------------------------------------------ sinks


def sink_oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches that overlap, appended by their keys; the second is sent twice."""
    keys, base = ["object", "replica", "counter"], _folder(spark)
    rows = log_queries.ops(spark, sf_dir).select(*keys)
    for part in ("counter % 3 <> 0", "counter % 2 = 0", "counter % 2 = 0"):
        sinks.append_new(rows.where(part), base, keys)
    return spark.read.parquet(base)


def sink_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors that two rounds move; a cursor never goes back."""
    base = _folder(spark)
    for part in ("counter <= 6000", "counter <= 3000"):
        sinks.advance(log_queries.ops(spark, sf_dir).where(part).select("object", "replica", "counter"), base, ["object", "replica"])
    return sinks.cursors(spark, base, ["object", "replica"])


def sink_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by segment, then the manifest that names them, read back together."""
    base, live = _folder(spark), search_queries.live_vectors(spark, sf_dir).where("segment IS NOT NULL").select("segment", "slot")
    sinks.write_segments(live, live.groupBy("segment").agg(F.count(F.lit(1)).alias("count")), base)
    held = spark.read.parquet(f"{base}/entries").groupBy("segment").agg(F.count(F.lit(1)).alias("slots"))
    return spark.read.parquet(f"{base}/manifest").join(held, "segment").select(F.col("segment").cast("long").alias("segment"), "count", "slots")


def sink_delete_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = log_queries.entries(spark, sf_dir).select("object", "segment", "slot").distinct()
    gone = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("object"))
    return segments.remove(gone, index)


# ------------------------------------------------------------------ codecs


def proj_oplog_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of an object's operations by their packed keys."""
    key = F.concat(F.unhex(F.md5(F.col("replica").cast("string").cast("binary"))), records.number(F.col("counter")))
    rows = log_queries.ops(spark, sf_dir).select("object", "counter", key.alias("key"))
    return numbered(rows, ["key"], within=("object",)).select("object", "counter", "place")


def proj_encode_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations to bytes and back; every fourth has a byte too many, every fifth one too few."""
    kinds = [("long", "counter"), ("long", "prev"), ("string", "object"), ("string", "replica")]
    rows = log_queries.ops(spark, sf_dir).withColumn("replica", F.col("replica").cast("string"))
    raw = records.pack([(k, F.col(c)) for k, c in kinds])
    n = F.col("counter")
    spoiled = F.when(n % 4 == 0, F.concat(raw, F.lit(b"x"))).when(n % 5 == 0, F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(raw)
    back = rows.select("counter", records.unpack(spoiled, kinds).alias("o"))
    fine = F.when(F.col("o.prev") < F.col("o.counter"), F.col("o"))
    return back.withColumn("o", fine).select("counter", F.coalesce("o.prev", F.lit(-1)).alias("prev"), F.coalesce("o.object", F.lit("")).alias("object"), F.coalesce("o.replica", F.lit("")).alias("replica"))


def proj_encode_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest adds to bytes and back: every field comes back and bytes are as many as the fields need."""
    kinds = [("long", "counter"), ("string", "model"), ("long", "segment"), ("long", "count")]
    rows = log_queries.manifest_ops(spark, sf_dir).where("kind = 'add'").distinct()
    coded = rows.select(records.pack([(k, F.col(c)) for k, c in kinds]).alias("raw"))
    return coded.select(F.octet_length("raw").cast("long").alias("bytes"), records.unpack(F.col("raw"), kinds).alias("o")).select("bytes", "o.*")


def proj_encode_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's marks to bytes and back; a mark of 0 and bytes left over are refused."""
    user = F.col("replica")
    mark = F.when((user % 6 == 0) & (F.col("counter") % 7 == 0), 0).otherwise(F.col("counter"))
    each = log_queries.ops(spark, sf_dir).groupBy(user, (F.col("counter") % 7).alias("source")).agg(F.max(mark).alias("mark"))
    maps = each.groupBy("replica").agg(F.map_from_entries(F.collect_list(F.struct("source", "mark"))).alias("marks"))
    raw = records.pack_marks(F.col("marks"))
    back = maps.select("replica", records.unpack_marks(F.when(user % 5 == 0, F.concat(raw, F.lit(b"\x00"))).otherwise(raw)).alias("m"))
    shown = F.array_join(F.transform("m", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return back.select("replica", F.coalesce(shown, F.lit("refused")).alias("marks"))


def proj_entry_to_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = search_queries.scores(spark, sf_dir)
    return ranked.select("q", F.col("slot").alias("vec_id"), F.col("segment").cast("string").alias("place"), search.rounded(F.col("score")).alias("score"))


# ------------------------------------------------------------------ filters


def flt_prefix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as bytes that start with seven zeros, and with six zeros and 255."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", records.number(F.col("o_orderkey")).alias("key"))
    wanted = records.has_prefix(F.col("key"), bytes(7)) | records.has_prefix(F.col("key"), bytes(6) + b"\xff")
    return rows.where(wanted).select("o_orderkey")


def flt_loopback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    url = F.when(n % 5 == 0, "http://127.0.0.9:80/x").when(n % 5 == 1, "https://LOCALHOST/x").when(n % 5 == 2, "http://[::1]:8/x").when(n % 5 == 3, "http://127.0.0.1.example/")
    return table(spark, sf_dir, "pages").select("page_id", records.is_loopback(url.otherwise(F.col("url"))).alias("is_local"))


def flt_legal_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    name = F.when(n % 5 == 0, "").when(n % 5 == 1, ".").when(n % 5 == 2, F.concat(F.lit("a/"), "c_name")).otherwise(F.concat(F.lit(".."), "c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", tree.legal_name(name).alias("legal"))


def flt_malformed_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that are used of those where some lost their number, their text or their count."""
    n = F.floor(F.col("counter") / 100)
    ops = text_queries._text_ops(spark, sf_dir).dropDuplicates(["object", "counter", "kind"])
    spoiled = (
        ops.withColumn("text", F.when((n % 13 == 0) & (F.col("kind") == "insert"), F.array().cast("array<int>")).otherwise(F.col("text")))
        .withColumn("count", F.when((n % 15 == 0) & (F.col("kind") == "delete"), 0).otherwise(F.col("count")))
        .withColumn("counter", F.when(n % 11 == 0, 0).otherwise(F.col("counter")))
    )
    return text_crdt.well_formed(spoiled).groupBy("kind").agg(F.count(F.lit(1)).alias("ops"))


# ------------------------------------------------------------------ sets and aggregates


def join_missing_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, present = log_queries.state(spark, sf_dir), log_queries.present(spark, sf_dir)
    wanted = state.where("count > 0").select("segment").join(present, "segment", "left_anti")
    return wanted.join(manifest.superseded(state, present), "segment", "left_anti")


def set_except_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_queries.state(spark, sf_dir).where("count > 0").select("segment").subtract(log_queries.present(spark, sf_dir))


def idx_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_missing_segments(spark, sf_dir).agg((F.count(F.lit(1)) == 0).alias("complete"))


def idx_adopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign segments: some of another model, some too wide, some damaged."""
    n = F.col("segment")
    rows = log_queries.live_slots(spark, sf_dir).select("segment").distinct()
    foreign = rows.select(
        n.cast("string").alias("segment"), F.when(n % 11 == 0, "other").otherwise("own").alias("model"), F.when(n % 7 == 0, 768).otherwise(384).alias("dimension"),
        F.when(n % 5 == 0, "0").otherwise(n.cast("string")).alias("digest"),
    )
    refused = F.coalesce("refused", F.lit("adopted")).alias("status")
    return segments.adoptable(foreign, "own", 384).groupBy(refused).agg(F.count(F.lit(1)).alias("segments"))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors under the first four as centres."""
    live = search_queries.live_vectors(spark, sf_dir)
    centres = [r["v"] for r in live.where("slot < 4").orderBy("slot").select(vectors.as_doubles(F.col("vector")).alias("v")).collect()]
    return topics.topic_map(live.withColumn("object", F.col("slot") % 100).withColumn("start", F.col("slot")), centres)


def agg_topic_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, notes and cohesion of each topic, and its share of the mean over all."""
    rows = _topics(spark, sf_dir)
    every = rows.agg(F.sum(F.col("chunks") * F.col("cohesion")).alias("_s"), F.sum("chunks").alias("_n"))
    return rows.crossJoin(every).select(F.col("cluster").cast("long").alias("cluster"), "chunks", "notes", F.round("cohesion", 6).alias("cohesion"), F.round(F.col("_s") / F.col("_n"), 6).alias("overall"))


def topic_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics named by a stand-in for a model: a digest of the excerpts, with the marks that a model puts around a title."""
    passages = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("object"), F.col("doc_id").alias("start"), "text")
    reply = lambda _, excerpts: F.concat(F.lit('# "**'), F.substring(F.md5(excerpts.cast("binary")), 1, 12), F.lit('.**"\nand more'))
    return topics.labelled(_topics(spark, sf_dir), passages, reply).select(F.col("cluster").cast("long").alias("cluster"), "label")


def sort_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.orderBy(F.desc("chunks"), F.desc("cohesion"), "cluster")
    return _topics(spark, sf_dir).select(F.col("cluster").cast("long").alias("cluster"), F.row_number().over(order).cast("long").alias("place"))


def st_lamport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of new operations numbered past the highest counter each user has seen."""
    seen = log_queries.ops(spark, sf_dir).groupBy("replica").agg(F.max("counter").alias("high"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    new = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("n"))
    return new.join(seen, F.col("o_custkey") == F.col("replica"), "left").select("o_orderkey", (F.coalesce("high", F.lit(0)) + F.col("n")).alias("counter"))


# ------------------------------------------------------------------ edits


def fold_text_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = text_crdt.ordered(text_queries._text_ops(spark, sf_dir))
    return chars.groupBy("object").agg(F.count(F.lit(1)).alias("chars"), F.sum(F.col("place") * F.col("code")).alias("mark"))


def gen_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a text typed after the second character of each note hangs."""
    ops = text_queries._text_ops(spark, sf_dir)
    wanted = ops.select("object").distinct().withColumn("at", F.lit(2))
    return text_crdt.inserts_at(ops, wanted).select("object", "parent_counter", "side")


def gen_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations that delete the first three characters of each note."""
    ops = text_queries._text_ops(spark, sf_dir)
    wanted = ops.select("object").distinct().select("object", F.lit(0).alias("at"), F.lit(3).alias("length"))
    return text_crdt.deletes_at(ops, wanted).select("object", "counter", "count")


def gen_set_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit between a document and the same with a mark put in place of five characters."""
    text, at = F.coalesce("text", F.lit("")), F.col("doc_id") % 40
    new = F.concat(F.substring(text, F.lit(1), at.cast("int")), F.lit("\x01"), F.substring(text, (at + 6).cast("int"), F.length(text)))
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object"), text.alias("old"), new.alias("new"))
    return text_crdt.edits(pairs).select(F.col("object").alias("doc_id"), "edit.start", "edit.deleted", F.length("edit.inserted").alias("inserted"))


def gen_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moves that bring the changes between two snapshots into the log."""
    events = text_queries.st_reconcile(spark, sf_dir).withColumn("id", F.nullif("id", F.lit(""))).withColumn("vault", F.lit("v"))
    return tree.moves_for(events, 100, "a").select("counter", "child", "parent", "name")


def tree_cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nations are put under each other; they and all below them are cut off."""
    swapped = F.when(F.col("child") == "n4", "n9").when(F.col("child") == "n9", "n4").otherwise(F.col("parent"))
    return tree.detached(text_queries._nodes(spark, sf_dir).withColumn("parent", swapped)).select("child")


# ------------------------------------------------------------------ sealing


def crypto_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts sealed and opened again; under another name they stay shut."""
    about, text = F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", records.seal(text, KEY, about).alias("sealed"))
    return rows.select(
        "doc_id", F.octet_length("sealed").cast("long").alias("bytes"), F.md5(records.unseal(F.col("sealed"), KEY, about).cast("binary")).alias("text_md5"),
        records.unseal(F.col("sealed"), KEY, F.lit("another")).isNull().alias("shut"),
    )


def crypto_seal_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts give equal bytes, and different texts different ones."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(F.sha2(records.seal(text, KEY, F.lit("all")), 256).alias("s"), F.sha2(text, 256).alias("t"))
    return rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("seals")).groupBy("n", "seals").agg(F.count(F.lit(1)).alias("texts"))


CHARS = """
WITH e AS (SELECT user_id::VARCHAR AS object, event_id AS n, event_type AS t, event_id % 5 = 0 AS gone FROM events),
c AS (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM e),
o AS (SELECT *, n * 100 + i AS counter, row_number() OVER (PARTITION BY object ORDER BY n, i) - 1 AS place, ord(substr(t, i::INT, 1)) AS code FROM c),
v AS (SELECT *, row_number() OVER (PARTITION BY object ORDER BY place) - 1 AS nth FROM o WHERE NOT gone)
"""
TOPICS = """
WITH s AS (SELECT a.vec_id AS slot, b.vec_id AS cluster, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
           FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 4) b),
m AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, cluster) AS rk FROM s),
t AS (SELECT cluster, count(*) AS chunks, count(DISTINCT slot % 100) AS notes, avg(score) AS cohesion FROM m WHERE rk = 1 GROUP BY cluster)
"""
SLOTS = log_queries.SLOTS

QUERIES = {
    f.__name__: f
    for f in (
        scan_tree, scan_index_live, scan_segment, scan_relay_fetch, scan_relay_reports, scan_relay_piece, limit_listing, limit_envelopes, scan_eval_tsv, sort_listing,
        sink_oplog, sink_cursor, sink_segment, sink_delete_object, proj_oplog_key, proj_encode_op, proj_encode_manifest, proj_encode_report, proj_entry_to_hit,
        flt_prefix_range, flt_loopback, flt_legal_name, flt_malformed_op, join_missing_segments, set_except_missing, idx_complete, idx_adopt, agg_topic_rollup,
        sort_topics, topic_label, st_lamport, fold_text_walk, gen_insert, gen_delete, gen_set_content, gen_change, tree_cycle_check,
        crypto_open, crypto_seal_det,
    )
}
ORACLES = {
    "scan_tree": """
SELECT 'r' || r_regionkey AS child, CASE WHEN r_regionkey = 3 THEN 'trash' ELSE 'root' END AS parent, r_name AS name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer""",
    "scan_index_live": SLOTS + "SELECT segment, slot, row_number() OVER (PARTITION BY segment ORDER BY slot) AS place FROM e WHERE NOT dead",
    "scan_segment": "SELECT l_orderkey AS segment, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS slots FROM lineitem WHERE l_orderkey % 9 <> 0 GROUP BY 1",
    "scan_relay_fetch": """
SELECT event_type AS object, event_id AS counter, user_id AS replica, place, total > 50 AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id, user_id) AS place, count(*) OVER (PARTITION BY event_type) AS total FROM events WHERE event_id > 1000)
WHERE place <= 50""",
    "scan_relay_reports": """
SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) WHERE place <= 3""",
    "scan_relay_piece": """
SELECT doc_id AS segment, 2000::BIGINT AS "offset", least(1000, strlen(text) - 2000) AS length FROM documents WHERE strlen(text) > 2000""",
    "limit_listing": "SELECT DISTINCT l_orderkey AS segment FROM lineitem WHERE l_orderkey > 1000 ORDER BY 1 LIMIT 4096",
    "limit_envelopes": "SELECT c_custkey FROM customer ORDER BY 1 LIMIT 256",
    "scan_eval_tsv": """
SELECT 'what is ' || CASE WHEN item_id % 3 = 1 THEN '' ELSE '"' END || item_id AS question, CASE WHEN item_id % 3 = 1 THEN '-' ELSE 'item ' || item_id END AS expected
FROM benchmark WHERE item_id % 3 <> 0""",
    "sort_listing": text_queries.NODES + "SELECT path, child, row_number() OVER (ORDER BY path, child) AS place FROM p WHERE top = 'root'",
    "sink_oplog": "SELECT event_type AS object, user_id AS replica, event_id AS counter FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0",
    "sink_cursor": "SELECT event_type AS object, user_id AS replica, max(event_id) AS counter FROM events WHERE event_id <= 6000 GROUP BY 1, 2",
    "sink_segment": "SELECT label::BIGINT AS segment, count(*) AS count, count(*) AS slots FROM embeddings WHERE label IS NOT NULL GROUP BY 1",
    "sink_delete_object": """
SELECT l_orderkey AS segment, l_linenumber AS slot FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem)
JOIN part ON l_partkey = p_partkey WHERE p_partkey % 10 = 0""",
    "proj_oplog_key": "SELECT event_type AS object, event_id AS counter, row_number() OVER (PARTITION BY event_type ORDER BY md5(user_id::VARCHAR), event_id) AS place FROM events",
    "proj_encode_op": log_queries.OPS + """
SELECT counter, CASE WHEN bad THEN -1 ELSE prev END AS prev, CASE WHEN bad THEN '' ELSE object END AS object, CASE WHEN bad THEN '' ELSE replica::VARCHAR END AS replica
FROM (SELECT *, counter % 4 = 0 OR counter % 5 = 0 OR prev >= counter AS bad FROM o)""",
    "proj_encode_manifest": """
SELECT l_orderkey * 100 + 1 AS counter, model, l_orderkey AS segment, count(DISTINCT l_linenumber) AS count, 28 + length(model) AS bytes
FROM (SELECT *, CASE WHEN l_orderkey % 11 = 0 THEN 'other' ELSE 'own' END AS model FROM lineitem) GROUP BY l_orderkey, model""",
    "proj_encode_report": """
WITH s AS (SELECT user_id, event_id % 7 AS source, CASE WHEN user_id % 6 = 0 AND event_id % 7 = 0 THEN 0 ELSE max(event_id) END AS mark
           FROM events GROUP BY user_id, event_id % 7, user_id % 6 = 0 AND event_id % 7 = 0)
SELECT user_id AS replica, CASE WHEN user_id % 5 = 0 OR min(mark) = 0 THEN 'refused' ELSE string_agg(source || '=' || mark, ',' ORDER BY source) END AS marks FROM s GROUP BY 1""",
    "proj_entry_to_hit": search_queries.SCORED + "SELECT q, slot AS vec_id, segment::VARCHAR AS place, round(score, 6) AS score FROM s",
    "flt_prefix_range": "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 0 AND 255 OR o_orderkey BETWEEN 65280 AND 65535",
    "flt_loopback": "SELECT page_id, page_id % 5 < 3 AS is_local FROM pages",
    "flt_legal_name": "SELECT c_custkey, c_custkey % 5 > 2 AS legal FROM customer",
    "flt_malformed_op": """
SELECT 'insert' AS kind, count(*) AS ops FROM events WHERE event_id % 13 <> 0 AND event_id % 11 <> 0
UNION ALL SELECT 'delete', count(*) FROM events WHERE event_id % 5 = 0 AND event_id % 15 <> 0 AND event_id % 11 <> 0""",
    "join_missing_segments": SLOTS + "SELECT segment FROM p WHERE count > 0 AND NOT here AND NOT replaced",
    "set_except_missing": SLOTS + "SELECT segment FROM p WHERE count > 0 AND NOT here",
    "idx_complete": SLOTS + "SELECT count(*) = 0 AS complete FROM p WHERE count > 0 AND NOT here AND NOT replaced",
    "idx_adopt": """
SELECT CASE WHEN n % 11 = 0 THEN 'model-mismatch' WHEN n % 7 = 0 THEN 'width-mismatch' WHEN n % 5 = 0 THEN 'damaged' ELSE 'adopted' END AS status, count(*) AS segments
FROM (SELECT DISTINCT l_orderkey AS n FROM lineitem) GROUP BY 1""",
    "agg_topic_rollup": TOPICS + """
SELECT cluster, chunks, notes, round(cohesion, 6) AS cohesion, round((SELECT sum(chunks * cohesion) / sum(chunks) FROM t), 6) AS overall FROM t""",
    "topic_label": TOPICS + """
, x AS (SELECT cluster, slot, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, slot % 100, slot) AS n FROM m WHERE rk = 1)
SELECT t.cluster, substr(md5(string_agg(text || chr(10) || '---' || chr(10), '' ORDER BY n)), 1, 12) AS label
FROM t LEFT JOIN x ON x.cluster = t.cluster AND n <= 3 LEFT JOIN documents ON doc_id = slot AND text <> '' GROUP BY t.cluster""",
    "sort_topics": TOPICS + "SELECT cluster, row_number() OVER (ORDER BY chunks DESC, cohesion DESC, cluster) AS place FROM t",
    "st_lamport": """
SELECT o_orderkey, coalesce(high, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS counter
FROM orders LEFT JOIN (SELECT user_id, max(event_id) AS high FROM events GROUP BY 1) ON user_id = o_custkey""",
    "fold_text_walk": CHARS + "SELECT object, count(*) AS chars, sum(place * code)::BIGINT AS mark FROM o GROUP BY 1",
    "gen_insert": CHARS + """
SELECT v.object, CASE WHEN length(t) = i THEN counter ELSE counter + 1 END AS parent_counter, CASE WHEN length(t) = i THEN 'right' ELSE 'left' END AS side FROM v WHERE nth = 1""",
    "gen_delete": CHARS + "SELECT object, min(counter) AS counter, count(*) AS count FROM v WHERE nth < 3 GROUP BY object, n",
    "gen_set_content": """
SELECT doc_id, least(doc_id % 40, n)::INT AS start, greatest(least(5, n - doc_id % 40), 0)::INT AS deleted, 1 AS inserted
FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)""",
    "gen_change": f"""
WITH f AS ({text_queries.ORACLES['st_reconcile']})
SELECT 100 + row_number() OVER (ORDER BY path, kind) AS counter, CASE WHEN id = '' THEN path ELSE id END AS child,
       CASE WHEN kind = 'deleted' THEN 'trash' ELSE split_part(path, '/', 1) END AS parent, split_part(path, '/', 2) AS name
FROM f WHERE kind <> 'modified'""",
    "tree_cycle_check": "SELECT 'n' || n_nationkey AS child FROM nation WHERE n_nationkey IN (4, 9) UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_nationkey IN (4, 9)",
    "crypto_open": "SELECT doc_id, strlen(coalesce(text, '')) + 28 AS bytes, md5(coalesce(text, '')) AS text_md5, true AS shut FROM documents",
    "crypto_seal_det": "SELECT n, 1::BIGINT AS seals, count(*) AS texts FROM (SELECT coalesce(text, '') AS t, count(*) AS n FROM documents GROUP BY 1) GROUP BY n",
}
