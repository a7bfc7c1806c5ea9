"""Smaller operators of the inventory over the driver tables: filters, joins, sets and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import codecs, text, vectors
from marginalia.operators import chunker, manifest, oplog, retrieval, search, segments, snapshot, text_crdt, tree
from marginalia.plans import log_queries, search_queries, text_queries
from marginalia.session import cut, numbered, table


def flt_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_queries.ops(spark, sf_dir).where("counter > 5000").select("object", "replica", "counter")


def flt_already_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations up to a replica's watermark are repeats by now."""
    marks = log_queries.ops(spark, sf_dir).groupBy("replica").agg((F.max("counter") / 2).cast("long").alias("mark"))
    rows = log_queries.ops(spark, sf_dir).join(marks, "replica")
    return rows.groupBy("replica").agg(F.count_if(F.col("counter") <= F.col("mark")).alias("settled"), F.count_if(F.col("counter") > F.col("mark")).alias("open"))


def flt_malformed_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    name = F.when(n % 5 == 0, "").when(n % 5 == 1, "..").when(n % 5 == 2, F.concat("c_name", F.lit("/"))).otherwise(F.col("c_name"))
    moves = table(spark, sf_dir, "customer").select(
        n.alias("counter"), F.concat(F.lit("c"), n).alias("child"), F.when(n % 7 == 0, F.concat(F.lit("c"), n)).otherwise("root").alias("parent"), name.alias("name")
    )
    return tree.well_formed(moves).select("counter", "name")


def flt_manifest_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = log_queries.manifest_ops(spark, sf_dir).withColumn("count", F.when(F.col("segment") % 13 == 0, 0).otherwise(F.col("count")))
    return manifest.distinct_ops(ops).groupBy("kind").agg(F.count(F.lit(1)).alias("ops"))


def flt_manifest_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second adds of every third segment by another device, of which some count otherwise."""
    ops = log_queries.manifest_ops(spark, sf_dir)
    n = F.col("segment")
    second = ops.where((F.col("kind") == "add") & (n % 3 == 0)).withColumn("replica", F.lit("d")).withColumn("count", F.when(n % 5 == 0, F.col("count") + 1).otherwise(F.col("count")))
    return manifest.conflicting(ops.unionByName(second.withColumn("counter", F.col("counter") + F.when(n % 2 == 0, 1).otherwise(-1))), log_queries.parts(spark, sf_dir))


def flt_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = log_queries.manifest_ops(spark, sf_dir).where("kind = 'add'").distinct()
    return ops.groupBy((F.col("model") == "own").alias("own")).agg(F.count(F.lit(1)).alias("adds"), F.sum("count").alias("vectors"))


def _raw() -> Column:
    """The bytes of a whole text; every third has the first half of a character at its end."""
    return F.expr("concat(encode(text, 'UTF-8'), CASE WHEN doc_id % 3 = 0 THEN X'C3' ELSE X'' END)")


def flt_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.is_valid_utf8(_raw().cast("string")).alias("valid"))


def flt_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.pool(spark, sf_dir).where("resolved").select("q", F.col("slot").alias("vec_id"))


def flt_demote_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.pool(spark, sf_dir).where(F.col("link_ratio") >= retrieval.LINK_DEMOTION).select("q", F.col("slot").alias("vec_id"), "link_ratio")


def join_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = manifest.live_entries(log_queries.live_slots(spark, sf_dir), log_queries.dead_slots(spark, sf_dir))
    return live.groupBy("segment").agg(F.count(F.lit(1)).alias("live"))


def join_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.superseded(log_queries.state(spark, sf_dir), log_queries.present(spark, sf_dir))


def join_push_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that are here and that the other side does not list."""
    listed = log_queries.live_slots(spark, sf_dir).select("segment").distinct().where("segment % 3 <> 0")
    return log_queries.present(spark, sf_dir).join(listed, "segment", "left_anti")


def join_previous_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an object was indexed before its newest segment."""
    rows = log_queries.entries(spark, sf_dir).select("object", "segment", "slot").distinct()
    newest = rows.groupBy("object").agg(F.max("segment").alias("segment"))
    return rows.join(newest, ["object", "segment"], "left_anti")


def join_roster_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    devices = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return devices.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("label"))


def join_path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tree.paths(text_queries._nodes(spark, sf_dir)).select("path", "child")
    wanted = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return wanted.select(F.concat_ws("/", "r_name", "n_name").alias("path")).join(paths, "path")


def join_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the exact ten a search of even slots alone would find."""
    live, asked = search_queries.live_vectors(spark, sf_dir), search_queries.question_vectors(spark, sf_dir)
    exact, found = search.topk(search.scored(live, asked, 10), 10), search.topk(search.scored(live.where("slot % 2 = 0"), asked, 10), 10)
    return exact.join(found.select("q", "segment", "slot"), ["q", "segment", "slot"], "left_semi").groupBy("q").agg(F.count(F.lit(1)).alias("found"))


def set_union_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_queries.entries(spark, sf_dir)
    slots = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("slot")))
    both = rows.groupBy("segment").agg(slots("R").alias("a"), slots("A").alias("b"))
    return both.select("segment", F.array_join(F.array_sort(F.array_union("a", "b")).cast("array<string>"), ",").alias("dead"))


def set_wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known, not here, and without a replacement that is here."""
    state, present = log_queries.state(spark, sf_dir), log_queries.present(spark, sf_dir)
    known = state.join(present, "segment", "left_anti").join(manifest.superseded(state, present), "segment", "left_anti")
    return known.select("segment")


def set_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    reporters = log_queries.ops(spark, sf_dir).select("replica").where("replica % 2 = 0")
    return reporters.union(spark.range(1).select(F.lit(-1).cast("long"))).distinct()


def set_intersect_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, asked = search_queries.live_vectors(spark, sf_dir), search_queries.question_vectors(spark, sf_dir)
    top = lambda d: search.topk(search.scored(d, asked, 20), 20).select("q", F.col("slot").alias("vec_id"))
    return top(live).intersect(top(live.where("slot % 3 <> 0")))


def win_best_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cut(search_queries.best_scores(spark, sf_dir))
    asked = search_queries.question_vectors(spark, sf_dir).join(best.select("q", (0.9 * F.col("best")).alias("least")), "q")
    near = best.join(search_queries.scores_above(spark, sf_dir, asked).select("q", "score"), "q", "left")
    return near.groupBy("q").agg(F.round(F.max("best"), 6).alias("best"), F.count_if(F.col("score") >= 0.9 * F.col("best")).alias("near_best"))


def win_second_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = retrieval.retrieval_shape(search.topk(search_queries.scores(spark, sf_dir, 2), 2))
    return shape.select("q", F.round("second_score", 6).alias("runner_up"))


def win_first_match_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = search.topk(search_queries.scores(spark, sf_dir, 50, apart=True).where("q <> slot"), 50)
    return ranked.groupBy("q").agg(F.coalesce(F.min(F.when(F.col("segment") == 3, F.col("rk"))), F.lit(0)).cast("long").alias("rank"))


def win_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(order) - 1).cast("long").alias("ordinal"))


def win_cited_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = text_queries._reply(spark, sf_dir).withColumn("cited", retrieval.citations(F.col("reply"), F.lit(3)))
    return replies.select("doc_id", F.posexplode(F.array(F.lit("p0"), F.lit("p1"), F.lit("p2"))).alias("place", "passage"), "cited").select(
        "doc_id", F.col("place").cast("long").alias("place"), F.array_contains("cited", F.col("place")).alias("is_cited")
    )


def proj_op_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = text_queries._text_ops(spark, sf_dir).dropDuplicates(["object", "counter", "kind"])
    return ops.groupBy("object").agg(F.sum(oplog.op_span(F.col("kind"), F.size("text"), F.col("count"))).cast("long").alias("ids"))


def proj_encode_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves to bytes and back; every fourth with a byte too many, which is refused."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, codecs.moves_to_bytes(k, F.lit("r"), F.concat(F.lit("c"), k), F.lit("root"), F.col("c_name"), F.lit(True)).alias("raw"))
    spoiled = F.when(k % 4 == 0, F.concat("raw", F.lit(b"x"))).otherwise(F.col("raw"))
    back = rows.select("c_custkey", codecs.moves_from_bytes(spoiled).alias("m"))
    return back.select("c_custkey", F.coalesce("m.name", F.lit("")).alias("name"), F.coalesce("m.counter", F.lit(0)).alias("counter"))


def proj_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("name"))


def proj_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("turn = 0").select(F.col("conv_id").alias("q"), F.md5("text").alias("question"))
    passages = turns.where("turn > 0").select(F.col("conv_id").alias("q"), F.col("turn").alias("place"), F.md5("text").alias("text"))
    return retrieval.prompt(asked, passages)


def proj_object_for_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.blake2(16)("url").alias("object"))


def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = log_queries.agg_index_stats(spark, sf_dir)
    return s.select((F.col("vectors") - F.col("tombstoned")).alias("vault_passages"), F.col("objects").alias("vault_notes"))


def agg_state_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the live tree: of each folder's sorted listing, of the folders in each of 256 parts, and of the parts."""
    line = F.concat("path", F.lit("|"), "child", F.lit("|"), F.when(F.col("is_dir"), "d").otherwise("f"))
    rows = tree.paths(text_queries._nodes(spark, sf_dir)).select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), line.alias("line"))
    listed = lambda key, text: F.md5(F.array_join(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(text).alias("t")))).getField("t"), "\n"))
    folders = rows.groupBy("folder").agg(listed("line", "line").alias("digest"))
    parts = folders.groupBy(F.substring(F.md5("folder"), 1, 2).alias("part")).agg(listed("folder", "digest").alias("digest"))
    return parts.agg(listed("part", "digest").alias("state"))


def agg_tombstone_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = text_crdt.nodes(text_queries._text_ops(spark, sf_dir))
    return chars.groupBy("object").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("deleted").alias("tombstones"), F.count_if(~F.col("deleted")).alias("length"))


def agg_log_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.compact_log(log_queries.ops(spark, sf_dir), 4000).agg(F.count(F.lit(1)).alias("rows"))


def sort_compaction_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(log_queries._sizes(spark, sf_dir).select("segment", "count"), ["count", "segment"])


def sort_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of change per folder, in the order they are reported."""
    rows = text_queries.st_reconcile(spark, sf_dir)
    kind = F.array_position(F.array(*[F.lit(k) for k in snapshot.KINDS]), F.col("kind"))
    return rows.groupBy(F.substring("path", 1, 1).alias("folder"), kind.alias("kind_order"), "kind").agg(F.count(F.lit(1)).alias("n"))


def fn_is_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.instr("text", "the") > 0).alias("has_the"))


def fn_atx_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that open a section, in text where some lines get marks."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    marked = F.concat(F.when(F.col("line") % 4 == 1, "## ").when(F.col("line") % 4 == 2, "#").when(F.col("line") % 4 == 3, "####### ").otherwise(""), "raw")
    return lines.withColumn("raw", marked).where(F.col("raw").rlike(r"^[ ]{0,3}#{1,6}(?![^ \t])")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("headings"))


def fn_json_extract_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("content"))).alias("j"))
    return rows.select("r_regionkey", F.get_json_object("j", "$.content").alias("content"))


def vec_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.as_doubles(F.col("embedding")).alias("v"))
    shifted = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("w"))
    return rows.join(shifted, "vec_id").select("vec_id", F.round(vectors.dot(F.col("v"), F.col("w")), 6).alias("score"))


def vec_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(F.col("vec_id") % 9 == 0, 0.0).otherwise(x.cast("double") * 3)).alias("v"))
    unit = vectors.normalise(F.col("v"))
    return rows.select("vec_id", unit.isNull().alias("degenerate"), F.coalesce(F.round(vectors.norm(unit), 6), F.lit(0.0)).alias("norm"))


def idx_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge of all orders' slots: how many live rows, numbered without gaps."""
    rows = log_queries.live_slots(spark, sf_dir).select(F.col("segment").cast("string").alias("segment"), "slot")
    dead = log_queries.dead_slots(spark, sf_dir).select(F.col("segment").cast("string").alias("segment"), "slot")
    merged, _ = segments.compact(rows, dead, rows.select("segment").distinct())
    return merged.agg(F.count(F.lit(1)).alias("live"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"))


def idx_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as they were sealed, against entries of which some are lost, cut short or changed since."""
    sealed = log_queries.live_slots(spark, sf_dir).withColumn("object", F.col("slot") * 7)
    n = F.col("segment")
    held = sealed.where((n % 31 != 0) & ~((n % 29 == 0) & (F.col("slot") == 1))).withColumn("object", F.when(n % 23 == 0, F.col("object") + 1).otherwise(F.col("object")))
    manifest_ = segments.digests(sealed).withColumn("model", F.when(n % 11 == 0, "other").otherwise("own")).withColumn("dimension", F.when(n % 13 == 0, 32).otherwise(64))
    return segments.opened(manifest_, held, "own", 64).select("segment", F.coalesce("refused", F.lit("opened")).alias("outcome"))


def proj_last_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last id each operation consumes, the latest of each note."""
    ops = text_queries._text_ops(spark, sf_dir)
    last = oplog.last_id(F.col("counter"), F.col("kind"), F.size("text"), F.col("count"))
    return ops.groupBy("object").agg(F.max(last).cast("long").alias("last_id"))


def idx_put_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as objects of ten; every fourth object changes, the rest must be left alone."""
    base = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("object"), (F.col("vec_id") % 10).cast("int").alias("ordinal"), F.lit(0).alias("start"), F.lit(1).alias("end"), vectors.as_doubles(F.col("embedding")).alias("vector")
    )
    held, _ = segments.put(base, base.limit(0).withColumn("segment", F.lit("")).withColumn("slot", F.lit(0)))
    changed = base.withColumn("end", F.when(F.col("object") % 4 == 0, 2).otherwise(1))
    added, dead = segments.put(changed, held, 1)
    return added.agg(F.count(F.lit(1)).alias("added")).crossJoin(dead.agg(F.count(F.lit(1)).alias("buried")))


def chunk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunker.chunk_status(_raw()).alias("status"))


SCORED, SLOTS, OPS = search_queries.SCORED, log_queries.SLOTS, log_queries.OPS
TEXT_OPS = "SELECT user_id::VARCHAR AS object, event_id, length(event_type) AS n FROM events"

QUERIES = {
    f.__name__: f
    for f in (
        flt_after_cursor, flt_already_compacted, flt_malformed_move, flt_manifest_malformed, flt_manifest_conflict, flt_model, flt_utf8, flt_resolved, flt_demote_link,
        join_tombstones, join_superseded, join_push_diff, join_previous_slots, join_roster_label, join_path_resolve, join_recall, set_union_dead,
        set_wants, set_devices, set_intersect_recall, win_best_broadcast, win_second_best, win_first_match_rank, win_ordinal, win_cited_flag,
        proj_op_span, proj_encode_tree, proj_basename, proj_prompt, proj_object_for_path, agg_coverage, agg_state_hash, agg_tombstone_count,
        agg_log_size, sort_compaction_inputs, sort_events, fn_is_substring, fn_atx_heading, fn_json_extract_string, vec_dot, vec_normalise,
        idx_compact, idx_open, proj_last_id, idx_put_object, chunk_status,
    )
}
ORACLES = {
    "flt_after_cursor": "SELECT event_type AS object, user_id AS replica, event_id AS counter FROM events WHERE event_id > 5000",
    "flt_already_compacted": """
WITH m AS (SELECT user_id, max(event_id) // 2 AS mark FROM events GROUP BY 1)
SELECT user_id AS replica, count(*) FILTER (event_id <= mark) AS settled, count(*) FILTER (event_id > mark) AS open FROM events JOIN m USING (user_id) GROUP BY 1""",
    "flt_malformed_move": "SELECT c_custkey AS counter, c_name AS name FROM customer WHERE c_custkey % 5 > 2 AND c_custkey % 7 <> 0 AND c_custkey > 0",
    "flt_manifest_malformed": SLOTS + """
SELECT 'add' AS kind, count(*) AS ops FROM s WHERE segment % 13 <> 0 UNION ALL SELECT 'tombstone', count(*) FROM e WHERE dead
UNION ALL SELECT 'retire', count(*) FROM s WHERE segment % 7 = 0""",
    "flt_manifest_conflict": SLOTS + """
, a AS (SELECT segment, count(*) AS n FROM e GROUP BY 1)
SELECT CASE WHEN segment % 2 = 0 THEN segment * 100 + 2 ELSE segment * 100 + 1 END AS counter, CASE WHEN segment % 2 = 0 THEN 'd' ELSE 'a' END AS replica, segment,
       CASE WHEN segment % 2 = 0 THEN n + 1 ELSE n END AS count, CASE WHEN segment % 2 = 0 THEN n ELSE n + 1 END AS agreed
FROM a WHERE segment % 15 = 0 AND NOT (segment = 0 AND segment % 2 = 1)""",
    "flt_model": SLOTS + "SELECT segment % 11 <> 0 AS own, count(DISTINCT segment) AS adds, count(*) AS vectors FROM e GROUP BY 1",
    "flt_resolved": search_queries.POOL + "SELECT q, slot AS vec_id FROM p WHERE resolved",
    "flt_demote_link": search_queries.POOL + "SELECT q, slot AS vec_id, link_ratio FROM p WHERE link_ratio >= 6000",
    "join_tombstones": SLOTS + "SELECT segment, count(*) AS live FROM e WHERE NOT dead GROUP BY 1",
    "join_superseded": SLOTS + "SELECT segment FROM p WHERE replaced",
    "join_push_diff": SLOTS + "SELECT segment FROM s WHERE here AND segment % 3 = 0",
    "join_previous_slots": """
WITH r AS (SELECT DISTINCT l_partkey AS object, l_orderkey AS segment, l_linenumber AS slot FROM lineitem)
SELECT object, segment, slot FROM (SELECT *, max(segment) OVER (PARTITION BY object) AS newest FROM r) WHERE segment < newest""",
    "join_roster_label": "SELECT s_suppkey, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "join_path_resolve": "SELECT r_name || '/' || n_name AS path, 'n' || n_nationkey AS child FROM region JOIN nation ON r_regionkey = n_regionkey WHERE r_regionkey <> 3",
    "join_recall": SCORED + """
, h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, segment, slot) AS n FROM s WHERE slot % 2 = 0)
SELECT k.q, count(*) AS found FROM k JOIN h ON k.q = h.q AND k.slot = h.slot WHERE k.rk <= 10 AND h.n <= 10 GROUP BY 1""",
    "set_union_dead": """
SELECT l_orderkey AS segment, coalesce(string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) FILTER (l_returnflag IN ('R', 'A')), '') AS dead FROM lineitem GROUP BY 1""",
    "set_wants": SLOTS + "SELECT segment FROM p WHERE NOT here AND NOT replaced",
    "set_devices": "SELECT DISTINCT user_id AS replica FROM events WHERE user_id % 2 = 0 UNION SELECT -1",
    "set_intersect_recall": SCORED + """
, h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, segment, slot) AS n FROM s WHERE slot % 3 <> 0)
SELECT q, slot AS vec_id FROM k WHERE rk <= 20 INTERSECT SELECT q, slot FROM h WHERE n <= 20""",
    "win_best_broadcast": SCORED + """
SELECT q, round(max(best), 6) AS best, count(*) FILTER (score >= 0.9 * best) AS near_best FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM s) GROUP BY q""",
    "win_second_best": SCORED + "SELECT q, round(score, 6) AS runner_up FROM k WHERE rk = 2",
    "win_first_match_rank": SCORED + """
, o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, segment, slot) AS n FROM s WHERE q <> slot)
SELECT q, coalesce(min(n) FILTER (segment = 3), 0) AS rank FROM o WHERE n <= 50 GROUP BY q""",
    "win_ordinal": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal FROM conversations",
    "win_cited_flag": text_queries.REPLY + """
SELECT doc_id, p.range AS place, contains(reply, '[' || (p.range + 1) || ']') AS is_cited FROM r CROSS JOIN range(3) p""",
    "proj_op_span": f"""
SELECT object, sum(n + CASE WHEN event_id % 5 = 0 THEN n ELSE 0 END)::BIGINT AS ids FROM ({TEXT_OPS}) GROUP BY 1""",
    "proj_encode_tree": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey END AS counter FROM customer",
    "proj_basename": "SELECT page_id, split_part(url, '/', -1) AS name FROM pages",
    "proj_prompt": """
WITH p AS (SELECT conv_id, string_agg('[' || turn || '] ' || md5(text), chr(10) ORDER BY turn) AS body FROM conversations WHERE turn > 0 GROUP BY 1)
SELECT conv_id AS q, 'Question: ' || md5(text) || chr(10) || chr(10) || 'Passages:' || chr(10) || body AS prompt FROM conversations JOIN p USING (conv_id) WHERE turn = 0""",
    "agg_coverage": SLOTS + "SELECT count(*) FILTER (NOT dead) AS vault_passages, count(DISTINCT object) FILTER (NOT dead) AS vault_notes FROM e",
    "agg_state_hash": text_queries.NODES + """

, l AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path || '|' || child || '|' || CASE WHEN is_dir THEN 'd' ELSE 'f' END AS line FROM p WHERE top = 'root'),
f AS (SELECT folder, md5(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY folder),
t AS (SELECT substr(md5(folder), 1, 2) AS part, md5(string_agg(digest, chr(10) ORDER BY folder)) AS digest FROM f GROUP BY 1)
SELECT md5(string_agg(digest, chr(10) ORDER BY part)) AS state FROM t""",
    "agg_tombstone_count": f"""
SELECT object, sum(n)::BIGINT AS nodes, coalesce(sum(n) FILTER (event_id % 5 = 0), 0)::BIGINT AS tombstones, coalesce(sum(n) FILTER (event_id % 5 <> 0), 0)::BIGINT AS length
FROM ({TEXT_OPS}) GROUP BY 1""",
    "agg_log_size": "SELECT count(*) AS rows FROM events WHERE event_id > 4000",
    "sort_compaction_inputs": log_queries.SIZES + "SELECT segment, count, row_number() OVER (ORDER BY count, segment) AS place FROM z",
    "sort_events": f"""
WITH f AS ({text_queries.ORACLES['st_reconcile']})
SELECT substr(path, 1, 1) AS folder, CASE kind WHEN 'created' THEN 1 WHEN 'modified' THEN 2 WHEN 'deleted' THEN 3 ELSE 4 END::BIGINT AS kind_order, kind, count(*) AS n FROM f GROUP BY 1, 2, 3""",
    "fn_is_substring": "SELECT doc_id, contains(text, 'the') AS has_the FROM documents",
    "fn_atx_heading": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
m AS (SELECT doc_id, CASE line % 4 WHEN 1 THEN '## ' WHEN 2 THEN '#' WHEN 3 THEN '####### ' ELSE '' END || raw AS raw FROM l)
SELECT doc_id, count(*) AS headings FROM m WHERE regexp_matches(raw, '^[ ]{0,3}#{1,6}([ \\t]|$)') GROUP BY 1""",
    "fn_json_extract_string": "SELECT r_regionkey, r_name AS content FROM region",
    "vec_dot": """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1""",
    "vec_normalise": "SELECT vec_id, vec_id % 9 = 0 AS degenerate, CASE WHEN vec_id % 9 = 0 THEN 0 ELSE 1 END::DOUBLE AS norm FROM embeddings",
    "idx_compact": SLOTS + "SELECT count(*) AS live, count(*) AS slots, count(*) - 1 AS last FROM e WHERE NOT dead",
    "idx_open": """
WITH e AS (SELECT DISTINCT l_orderkey AS segment, l_linenumber AS slot FROM lineitem),
s AS (SELECT segment, count(*) AS n, count(*) FILTER (slot = 1) AS firsts FROM e GROUP BY segment)
SELECT segment, CASE WHEN segment % 11 = 0 THEN 'model-mismatch' WHEN segment % 13 = 0 THEN 'width-mismatch' WHEN segment % 31 = 0 THEN 'missing'
                     WHEN segment % 29 = 0 AND firsts = n THEN 'missing' WHEN segment % 29 = 0 AND firsts > 0 THEN 'truncated' WHEN segment % 23 = 0 THEN 'damaged' ELSE 'opened' END AS outcome FROM s""",
    "proj_last_id": """
SELECT user_id::VARCHAR AS object, max(event_id * 100 + length(event_type) + CASE WHEN event_id % 5 = 0 THEN 50 ELSE 0 END)::BIGINT AS last_id FROM events GROUP BY 1""",
    "flt_utf8": "SELECT doc_id, doc_id % 3 <> 0 AS valid FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL",
    "idx_put_object": """
SELECT count(*) AS added, count(*) AS buried FROM embeddings WHERE vec_id // 10 % 4 = 0""",
}
