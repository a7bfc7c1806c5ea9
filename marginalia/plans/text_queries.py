"""Change detection, trees, text and passages over the driver tables.

Two snapshots of a folder come from ``orders``: the path is the order, its inode
the customer and the order, its hash the price. Between them some are deleted,
edited, moved or replaced by arithmetic on the key. The tree is customers under
nations under regions. ``documents`` are notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import chunker, retrieval, search, snapshot, text_crdt, tree
from marginalia.plans import state_queries
from marginalia.session import table
from marginalia.sources import hints
from marginalia.sources.sinks import json_events
from marginalia.streaming import flows


def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").where(k % 13 != 0)
    return rows.select(
        F.concat(F.lit("n/"), k, F.lit(".md")).alias("path"), F.concat(F.lit("id"), k).alias("id"), F.lit(1).alias("dev"), k.alias("ino"),
        F.when(k % 17 == 0, 2).otherwise(1).alias("nlink"), F.col("o_orderstatus").alias("hash"),
    )


def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 11th order is gone, every 7th moved to another folder, every 5th edited, every 9th has a new inode."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").where(k % 11 != 0)
    folder = F.when(k % 7 == 0, "m/").otherwise("n/")
    return rows.select(
        F.concat(folder, k, F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("id"), F.lit(1).alias("dev"),
        F.when(k % 9 == 0, k + 10000000).otherwise(k).alias("ino"), F.when(k % 17 == 0, 2).otherwise(1).alias("nlink"),
        F.when(k % 5 == 0, F.concat(F.lit("x"), "o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("hash"),
    )


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames were reported for moved orders that divide by 2."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where((k % 7 == 0) & (k % 2 == 0)).select(F.concat(F.lit("m/"), k, F.lit(".md")).alias("path"), F.lit(True).alias("renamed"))


def join_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot.deltas(before(spark, sf_dir), now(spark, sf_dir))
    return rows.groupBy("arrived", "vacated").agg(F.count(F.lit(1)).alias("paths"))


def join_move_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.moves(snapshot.deltas(before(spark, sf_dir), now(spark, sf_dir)), renamed(spark, sf_dir))


def st_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot.reconcile(before(spark, sf_dir), now(spark, sf_dir), renamed(spark, sf_dir))
    return rows.select("kind", "path", *[F.coalesce(c, F.lit("")).alias(c) for c in ("old_path", "id", "hash")])


def _hinted_events(spark: SparkSession, sf_dir: str, lost: bool = False, torn: bool = False) -> DataFrame:
    """The events that a stream of hints leads to, until nothing is hinted any more."""
    base = state_queries.new_folder(spark)
    old, new, asked = before(spark, sf_dir), now(spark, sf_dir), renamed(spark, sf_dir)
    log, looks = hints.HintLog(f"{base}/hints"), []
    others = old.select("path").union(new.select("path")).distinct().join(asked, "path", "left_anti").withColumn("renamed", F.lit(False))
    log.emit_all(others)
    if lost:
        log.keep(0)
    log.emit_all(asked)
    in_place = old.select("path", "ino").join(new.select("path", "ino"), ["path", "ino"]).where("ino % 3 = 0").select("path", F.lit(True).alias("_torn"))

    def current() -> DataFrame:
        looks.append(1)
        if not torn or len(looks) > 1:
            return new
        return new.join(in_place, "path", "left").withColumn("stable", F.col("_torn").isNull()).drop("_torn")

    keep = lambda events: events.write.mode("append").parquet(f"{base}/events")
    again = lambda rows: log.emit_all(rows)
    step = flows.reconcile_batches(spark, old, current, keep, f"{base}/kept", again)
    for _ in range(2 if torn else 1):
        stream = hints.hint_stream(spark, log.path).writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        stream.foreachBatch(step).start().awaitTermination()
    return spark.read.parquet(f"{base}/events").select("kind", "path", *[F.coalesce(c, F.lit("")).alias(c) for c in ("old_path", "id", "hash")])


def src_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hints that were given by hand."""
    return _hinted_events(spark, sf_dir)


def st_overflow_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most hints were lost before they were read; one for the root stands in for them."""
    return _hinted_events(spark, sf_dir, lost=True)


def st_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files that stayed in place was being written at the first look: they are hinted again."""
    return _hinted_events(spark, sf_dir, torn=True)


def join_hint_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    paths = table(spark, sf_dir, "orders").select(F.concat(F.lit("v/"), k % 40, F.lit("/"), k, F.lit(".md")).alias("path"))
    asked = spark.range(20).select(
        F.when(F.col("id") < 10, F.concat(F.lit("v/"), F.col("id") * 3)).otherwise(F.concat(F.lit("v/"), F.col("id") % 40, F.lit("/"), F.col("id"), F.lit(".md"))).alias("path"),
        (F.col("id") % 2 == 0).alias("renamed"),
    )
    return snapshot.hinted(paths, asked)


def flt_vault_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".md").when(F.col("page_id") % 3 == 1, ".MD").otherwise(".txt"))
    return table(spark, sf_dir, "pages").select("page_id", snapshot.is_vault_file(url).alias("is_note"))


def flt_path_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("v/"), F.col("o_orderkey") % 40, F.lit("/"), F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").where(snapshot.is_under(path, F.lit("v/3"))).select("o_orderkey")


def join_local_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select(F.concat(F.lit("n/"), "doc_id").alias("path"), "doc_id", "text")
    held = notes.where("doc_id % 10 <> 3").select("path", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")).alias("text"))
    return snapshot.local_changes(notes.select("path", "text"), held).select("path", "kind")


def join_case_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).otherwise(F.initcap("c_mktsegment")).alias("path")
    )
    found = snapshot.case_collisions(names)
    return found.select("folded", "n", F.array_join("paths", "|").alias("paths"))


def fn_fold_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(snapshot.fold_case(F.col("text")).cast("binary")).alias("folded_md5"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer; the third region is in the trash."""
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    region = table(spark, sf_dir, "region").select(
        named("r", "r_regionkey").alias("child"), F.when(F.col("r_regionkey") == 3, "trash").otherwise("root").alias("parent"), F.col("r_name").alias("name"), F.lit(True).alias("is_dir")
    )
    nation = table(spark, sf_dir, "nation").select(
        named("n", "n_nationkey").alias("child"), named("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit(True).alias("is_dir")
    )
    customer = table(spark, sf_dir, "customer").select(
        named("c", "c_custkey").alias("child"), named("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"), F.lit(False).alias("is_dir")
    )
    return region.unionByName(nation).unionByName(customer).withColumn("vault", F.lit("v"))


def tree_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.paths(_nodes(spark, sf_dir)).select("child", "path", "is_dir")


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.paths(_nodes(spark, sf_dir)).where("NOT is_dir").select("path", "child")


def tree_is_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.deleted(_nodes(spark, sf_dir)).select("child")


def join_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children(_nodes(spark, sf_dir), "r1").select("child", "name")


def fold_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as moves: each puts a customer under another of its vault of thirty; cycles are skipped."""
    return tree.fold(state_queries.moves(spark, sf_dir)).select("vault", "child", "parent")


def _text_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events write a note: an insert after the previous one, and every fifth deletes it again."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("object"), F.col("event_id").alias("n"), "event_type")
    codes = F.transform(F.split("event_type", ""), lambda c: F.ascii(c))
    counter = F.col("n") * 100 + 1
    inserts = rows.select(
        "object", counter.alias("counter"), F.lit("r").alias("replica"), F.lit("insert").alias("kind"), F.lit(None).cast("struct<counter:bigint,replica:string>").alias("parent"),
        F.lit("right").alias("side"), F.filter(codes, lambda c: c > 0).alias("text"), F.lit(None).cast("struct<counter:bigint,replica:string>").alias("target"), F.lit(None).cast("int").alias("count"),
    )
    deletes = rows.where("n % 5 = 0").select(
        "object", (counter + 50).alias("counter"), F.lit("r").alias("replica"), F.lit("delete").alias("kind"), F.lit(None).cast("struct<counter:bigint,replica:string>").alias("parent"),
        F.lit(None).cast("string").alias("side"), F.lit(None).cast("array<int>").alias("text"), F.struct(counter.alias("counter"), F.lit("r").alias("replica")).alias("target"), F.length("event_type").alias("count"),
    )
    return inserts.unionByName(deletes).unionByName(inserts.where("counter % 7 = 0"))


def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_crdt.fold(_text_ops(spark, sf_dir)).select("object", F.md5(F.col("text").cast("binary")).alias("text_md5"), "length", "tombstones")


def proj_explode_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_crdt.characters(_text_ops(spark, sf_dir)).groupBy("object").agg(F.count(F.lit(1)).alias("chars"), F.sum("code").cast("long").alias("codes"))


def proj_explode_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_crdt.deletions(_text_ops(spark, sf_dir)).groupBy("object").agg(F.count(F.lit(1)).alias("chars"))


def join_op_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters whose run lost its first one: every seventh run arrives without it."""
    every = text_crdt.characters(_text_ops(spark, sf_dir))
    known = every.where("NOT (parent_counter IS NULL AND (counter - 1) / 100 % 7 = 0)")
    have = known.select("object", F.col("counter").alias("parent_counter"))
    return known.where("parent_counter > 0").join(have, ["object", "parent_counter"], "left_anti").select("object", "counter")


def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = text_crdt.nodes(_text_ops(spark, sf_dir))
    mark = spark.range(1).select(F.lit("r").alias("replica"), F.lit(10**9).cast("long").alias("counter"))
    return text_crdt.compacted(chars, mark).groupBy("object").agg(F.count(F.lit(1)).alias("chars"), F.count_if("deleted").alias("tombstones"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object"), "text")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = chunker.chunks(_notes(spark, sf_dir))
    return passages.select(F.col("object").alias("doc_id"), "ordinal", "start", "end", "kind", "link_ratio", F.octet_length("text").alias("text_bytes"))


def agg_chunk_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.digests(chunker.chunks(_notes(spark, sf_dir))).withColumnRenamed("object", "doc_id")


def agg_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build reports, checked on what does not depend on where passages are cut."""
    passages = chunker.chunks(_notes(spark, sf_dir))
    each = passages.groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("end").alias("last"))
    return each.agg(F.count(F.lit(1)).alias("files"), F.sum("first").alias("first_bytes"), F.sum("last").alias("last_bytes"))


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.line_offsets(_notes(spark, sf_dir)).select(F.col("object").alias("doc_id"), F.col("line").cast("long").alias("line"), "start", "end")


def fn_link_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with every fourth word turned into a link, ASCII only."""
    plain = F.regexp_replace("html", r"[^A-Za-z0-9 ]", "")
    linked = F.regexp_replace(plain, r"([A-Za-z0-9]+) ([A-Za-z0-9]+) ([A-Za-z0-9]+)", "$1 [[$2]] [$3](x)")
    return table(spark, sf_dir, "pages").select("page_id", chunker.link_ratio(linked).alias("link_ratio"))


def fn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.words(F.regexp_replace("text", r"[^\x00-\x7F]", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.md5(F.array_join(words, " ").cast("binary")).alias("words_md5"))


def fn_utf8_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("characters"), F.is_valid_utf8("text").alias("valid"))


def vec_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    v = docs.select("doc_id", text.hash_embed(64)("text").alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"))


def fn_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.blake2(32)("text").alias("digest"))


def _reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    head = F.when(n % 4 == 0, "VERDICT: ANSWER\n").when(n % 4 == 1, "** verdict: no-answer\n").when(n % 4 == 2, "\n# Verdict: Answer\n").otherwise("")
    body = F.concat(F.regexp_replace("text", r"[\[\]\n]", ""), F.lit(" ["), n % 9, F.lit("] and ["), n % 3, F.lit("]["), n % 3, F.lit("]"))
    cited = F.when(n % 5 == 0, F.lit("nothing")).otherwise(body)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, cited).alias("reply"))


def fn_parse_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = retrieval.citations(F.col("reply"), F.lit(6))
    return _reply(spark, sf_dir).select("doc_id", F.array_join(cited.cast("array<string>"), ",").alias("cited"))


def fn_read_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reply(spark, sf_dir).select("doc_id", retrieval.verdict(F.col("reply")).alias("verdict"))


def answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    status = retrieval.answer_status(n % 50 != 7, F.when(n % 10 == 9, 0).otherwise(6), n % 20 != 3, F.when(n % 30 != 11, F.col("reply")))
    return _reply(spark, sf_dir).select("doc_id", status.alias("status"))


def sink_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    back = F.from_json("value", "event string, n_nationkey int, n_name string")
    return json_events(rows, "note").select(back.alias("e")).select("e.*")


def scan_doc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that some document contains: a stated set of queries against all documents, a bounded block of them at a time."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("want"))
    blocks = max(1, -(-asked.count() // search.QUERY_BLOCK))
    wanted = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        hits = docs.crossJoin(F.broadcast(wanted.where(F.col("block") == b))).where(F.contains(F.col("text"), F.col("want"))).select("item_id", "doc_id")
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


def fn_topic_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.topic_count(F.col("p_partkey")).alias("topics"))


def fn_ctx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.context_tokens(F.repeat("text", 4)).alias("tokens"))


def fn_label_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit('  "**'), F.col("n_name"), F.lit('.**"\nmore'))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.label(reply).alias("label"))


SNAPSHOTS = """
WITH b AS (SELECT o_orderkey AS k, 'n/' || o_orderkey || '.md' AS path, 'id' || o_orderkey AS id, o_orderkey AS ino,
                  CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS nlink, o_orderstatus AS hash FROM orders WHERE o_orderkey % 13 <> 0),
n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'm/' ELSE 'n/' END || o_orderkey || '.md' AS path,
             CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS ino, CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS nlink,
             CASE WHEN o_orderkey % 5 = 0 THEN 'x' || o_orderstatus ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 11 <> 0),
d AS (SELECT coalesce(b.path, n.path) AS path, b.id, b.ino AS ino_b, n.ino AS ino_n, b.nlink AS nlink_b, n.nlink AS nlink_n, b.hash AS hash_b, n.hash AS hash_n,
             n.path IS NOT NULL AND (b.path IS NULL OR b.ino <> n.ino) AS arrived, b.path IS NOT NULL AND (n.path IS NULL OR b.ino <> n.ino) AS vacated
      FROM b FULL JOIN n ON b.path = n.path),
m AS (SELECT a.path, v.path AS old_path, v.id, a.hash_n AS hash FROM d a JOIN d v ON a.arrived AND v.vacated AND a.ino_n = v.ino_b
      WHERE a.path <> v.path AND a.nlink_n <= 1 AND v.nlink_b <= 1 AND a.path LIKE 'm/%' AND a.ino_n % 2 = 0)
"""
NODES = """
WITH RECURSIVE x AS (
  SELECT 'r' || r_regionkey AS child, CASE WHEN r_regionkey = 3 THEN 'trash' ELSE 'root' END AS parent, r_name AS name, true AS is_dir FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, true FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, false FROM customer),
p AS (SELECT child, name AS path, is_dir, parent AS top FROM x WHERE parent IN ('root', 'trash')
      UNION ALL SELECT x.child, p.path || '/' || x.name, x.is_dir, p.top FROM x JOIN p ON x.parent = p.child)
"""
REPLY = """
WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'VERDICT: ANSWER' || chr(10) WHEN 1 THEN '** verdict: no-answer' || chr(10)
                                         WHEN 2 THEN chr(10) || '# Verdict: Answer' || chr(10) ELSE '' END
           || CASE WHEN doc_id % 5 = 0 THEN 'nothing' ELSE regexp_replace(text, '[\\[\\]\\n]', '', 'g')
              || ' [' || doc_id % 9 || '] and [' || doc_id % 3 || '][' || doc_id % 3 || ']' END AS reply FROM documents)
"""

QUERIES = {
    f.__name__: f
    for f in (
        join_snapshot_diff, join_move_detect, st_reconcile, src_manual, st_overflow_rescan, st_retry, join_hint_expand, flt_vault_file, flt_path_under, join_local_changes, join_case_collision,
        fn_fold_case, tree_path, tree_listing, tree_is_deleted, join_children, fold_tree, fold_text, proj_explode_run, proj_explode_delete,
        join_op_parent, compact_text, chunk_documents, agg_chunk_digest, agg_build_stats, chunk_lines, fn_link_ratio, fn_words, fn_utf8_len,
        vec_hash_embed, fn_blake2b, fn_parse_citations, fn_read_verdict, answer, sink_json_events, scan_doc_lookup, fn_topic_count, fn_ctx_tokens, fn_label_cleanup,
    )
}
ORACLES = {
    "join_snapshot_diff": SNAPSHOTS + "SELECT arrived, vacated, count(*) AS paths FROM d GROUP BY 1, 2",
    "join_move_detect": SNAPSHOTS + "SELECT * FROM m",
    "st_reconcile": SNAPSHOTS + """
, e AS (
  SELECT CASE WHEN ar AND va THEN CASE WHEN hash_b <> hash_n THEN 'modified' END WHEN ar THEN 'created' WHEN va THEN 'deleted'
              WHEN NOT arrived AND NOT vacated AND hash_b <> hash_n THEN 'modified' END AS kind, * FROM (
    SELECT *, arrived AND path NOT IN (SELECT path FROM m) AS ar, vacated AND path NOT IN (SELECT old_path FROM m) AS va FROM d))
SELECT kind, path, '' AS old_path, CASE WHEN kind = 'created' THEN '' ELSE coalesce(id, '') END AS id, CASE WHEN kind = 'deleted' THEN '' ELSE coalesce(hash_n, '') END AS hash
FROM e WHERE kind IS NOT NULL UNION ALL SELECT 'moved', path, old_path, id, hash FROM m""",
    "join_hint_expand": """
WITH p AS (SELECT 'v/' || o_orderkey % 40 || '/' || o_orderkey || '.md' AS path FROM orders),
h AS (SELECT CASE WHEN range < 10 THEN 'v/' || range * 3 ELSE 'v/' || range % 40 || '/' || range || '.md' END AS hint, range % 2 = 0 AS renamed FROM range(20))
SELECT path, bool_or(renamed) AS renamed FROM p JOIN h ON path = hint OR starts_with(path, hint || '/') GROUP BY path""",
    "flt_vault_file": """
SELECT page_id, regexp_matches(n, '\\.[mM][dD]$') AND NOT regexp_matches(n, '^[.#]') AS is_note FROM (
  SELECT page_id, split_part(u, '/', -1) AS n FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.MD' ELSE '.txt' END AS u FROM pages))""",
    "flt_path_under": "SELECT o_orderkey FROM orders WHERE o_orderkey % 40 = 3",
    "join_local_changes": """
SELECT 'n/' || doc_id AS path, CASE WHEN doc_id % 10 = 3 THEN 'created' ELSE 'modified' END AS kind FROM documents WHERE doc_id % 10 = 3 OR doc_id % 4 = 0""",
    "join_case_collision": """
WITH n AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS path FROM customer)
SELECT lower(path) AS folded, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths FROM n GROUP BY 1 HAVING count(*) > 1""",
    "fn_fold_case": "SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS folded_md5 FROM documents",
    "tree_path": NODES + "SELECT child, path, is_dir FROM p WHERE top = 'root'",
    "tree_listing": NODES + "SELECT path, child FROM p WHERE top = 'root' AND NOT is_dir",
    "tree_is_deleted": NODES + "SELECT child FROM p WHERE top = 'trash'",
    "fold_tree": state_queries.FOLD,
    "join_children": "SELECT 'n' || n_nationkey AS child, n_name AS name FROM nation WHERE n_regionkey = 1",
    "fold_text": """
SELECT user_id::VARCHAR AS object, md5(coalesce(string_agg(event_type, '' ORDER BY event_id) FILTER (event_id % 5 <> 0), '')) AS text_md5,
       coalesce(sum(length(event_type)) FILTER (event_id % 5 <> 0), 0)::BIGINT AS length, coalesce(sum(length(event_type)) FILTER (event_id % 5 = 0), 0)::BIGINT AS tombstones
FROM events GROUP BY 1""",
    "proj_explode_run": """
SELECT object, count(*) AS chars, sum(code)::BIGINT AS codes FROM (
  SELECT user_id::VARCHAR AS object, ascii(unnest(string_split(event_type, ''))) AS code FROM events) GROUP BY 1""",
    "proj_explode_delete": "SELECT user_id::VARCHAR AS object, sum(length(event_type))::BIGINT AS chars FROM events WHERE event_id % 5 = 0 GROUP BY 1",
    "join_op_parent": "SELECT user_id::VARCHAR AS object, event_id * 100 + 2 AS counter FROM events WHERE event_id % 7 = 0 AND length(event_type) > 1",
    "compact_text": """
SELECT user_id::VARCHAR AS object, sum(length(event_type))::BIGINT AS chars, 0::BIGINT AS tombstones FROM events WHERE event_id % 5 <> 0 GROUP BY 1""",
    "agg_build_stats": """
SELECT count(*) AS files, 0::BIGINT AS first_bytes, sum(strlen(text))::BIGINT AS last_bytes FROM documents WHERE strlen(text) > 0""",
    "chunk_lines": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
o AS (SELECT *, coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)
SELECT doc_id, line, start, start + strlen(regexp_replace(raw, chr(13) || '$', '')) AS "end" FROM o""",
    "fn_link_ratio": """
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '[^A-Za-z0-9 ]', '', 'g'), '([A-Za-z0-9]+) ([A-Za-z0-9]+) ([A-Za-z0-9]+)', '\\1 [[\\2]] [\\3](x)', 'g') AS b FROM pages),
s AS (SELECT page_id, coalesce(list_sum(list_transform(regexp_extract_all(b, '\\[\\[[^\\]]*\\]\\]|\\[[^\\]]*\\]\\([^)]*\\)'), lambda m: length(m))), 0) AS linked,
             length(replace(b, ' ', '')) AS solid FROM p)
SELECT page_id, CASE WHEN solid = 0 THEN 0 ELSE least(linked * 10000 // solid, 10000) END::INT AS link_ratio FROM s""",
    "fn_words": """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')), '[a-z0-9]+') AS words FROM documents)
SELECT doc_id, len(words) AS words, md5(array_to_string(words, ' ')) AS words_md5 FROM w""",
    "fn_utf8_len": "SELECT doc_id, strlen(text) AS bytes, length(text) AS characters, true AS valid FROM documents",
    "fn_parse_citations": REPLY + """
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(
  regexp_extract_all(reply, '\\[([0-9]{1,4})\\]', 1), lambda x: x::INT), lambda x: x BETWEEN 1 AND 6), lambda x: x - 1))), ','), '') AS cited FROM r""",
    "fn_read_verdict": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'no-answer' WHEN 2 THEN 'answer' ELSE 'absent' END AS verdict FROM documents",
    "answer": """
SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'retrieval-failed' WHEN doc_id % 10 = 9 THEN 'no-passages' WHEN doc_id % 20 = 3 THEN 'answered'
                    WHEN doc_id % 30 = 11 THEN 'generation-failed' WHEN doc_id % 4 IN (1, 3) THEN 'no-answer-in-passages'
                    WHEN doc_id % 5 = 0 OR (doc_id % 9 NOT BETWEEN 1 AND 6 AND doc_id % 3 = 0) THEN 'ungrounded' ELSE 'answered' END AS status FROM documents""",
    "sink_json_events": "SELECT 'note' AS event, n_nationkey, n_name FROM nation",
    "scan_doc_lookup": "SELECT item_id, count(DISTINCT doc_id) AS documents FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id",
    "fn_topic_count": """
SELECT p_partkey, CASE WHEN p_partkey < 2 THEN 0 WHEN p_partkey < 4 THEN 2 ELSE greatest(least(round(sqrt(p_partkey / 2.0)), 20), 2) END::INT AS topics FROM part""",
    "fn_ctx_tokens": """
SELECT doc_id, least(greatest(pow(2, ceil(log2(strlen(text) * 4 / 3.0 + 1024))), 4096), 32768)::INT AS tokens FROM documents""",
    "fn_label_cleanup": "SELECT n_nationkey, n_name AS label FROM nation",
}
ORACLES |= {name: ORACLES["st_reconcile"] for name in ("src_manual", "st_overflow_rescan", "st_retry")}
