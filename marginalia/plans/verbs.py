"""The verbs of a notes index: build, ask, evaluate, topics, stats, compact.

An index is a folder with four tables: ``entries`` (one row per passage, dealt
into buckets of the segment's hash), ``tombstones``, ``manifest`` and ``notes`` (digests
of the texts it was built from). Rows are only ever added; a passage is live while nothing buries it and nothing present replaces
its segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import chunker, manifest, retrieval, search, segments, topics
from marginalia.session import cut
from marginalia.sources.sinks import exists

DIMENSION, BUCKETS = 128, 64
ENTRIES = (
    "segment string, slot int, object string, ordinal int, start int, end int, kind string, link_ratio int, heading_path string, vector array<double>, bucket int"
)
NOTES = "object string, digest string, turn long"
TOMBSTONES, MANIFEST = "segment string, slot int", "kind string, segment string, count long, superseded_by string"


def _table(spark: SparkSession, index: str, name: str, schema: str) -> DataFrame:
    """One of the index's tables, without rows where nothing was written yet."""
    if not exists(spark, f"{index}/{name}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{index}/{name}")


def _append(rows: DataFrame, index: str, name: str, *by: str) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(f"{index}/{name}")


def entries(spark: SparkSession, index: str) -> DataFrame:
    """Live passages."""
    every = _table(spark, index, "entries", ENTRIES)
    state = _table(spark, index, "manifest", MANIFEST)
    present = every.select("segment").distinct()
    replaced = state.where("kind = 'retire'").join(present.withColumnRenamed("segment", "superseded_by"), "superseded_by", "left_semi")
    alive = every.join(replaced.select("segment").distinct(), "segment", "left_anti")
    return alive.join(_table(spark, index, "tombstones", TOMBSTONES), ["segment", "slot"], "left_anti")


def embedded(passages: DataFrame, column: str = "text", dimension: int = DIMENSION) -> DataFrame:
    return passages.withColumn("vector", text.hash_embed(dimension)(column))


def build(notes: DataFrame, index: str, dimension: int = DIMENSION) -> DataFrame:
    """Bring the index up to date with ``notes(object, text)``; one row of what was done.

    A note is known by the digest of its text: one whose text is as it was is neither cut
    nor embedded. Digests are written last, so a build that breaks off is done again, and
    passages that are there by then are left alone.
    """
    spark = notes.sparkSession
    digests = _table(spark, index, "notes", NOTES)
    turn = (digests.agg(F.max("turn")).first()[0] or 0) + 1
    known = digests.groupBy("object").agg(F.max_by("digest", "turn").alias("digest")).where("digest IS NOT NULL")
    now = notes.select("object", F.sha2(F.concat_ws(":", F.lit(str(dimension)), F.coalesce("text", F.lit(""))), 256).alias("digest"))
    changed = cut(now.join(known, ["object", "digest"], "left_anti"))
    lost = cut(known.select("object").join(now, "object", "left_anti").select("object", F.lit(None).cast("string").alias("digest")))
    looked_at = notes.join(changed.select("object"), "object", "left_semi")
    passages = embedded(chunker.chunks(looked_at), dimension=dimension).where("vector IS NOT NULL").drop("text")
    held = entries(spark, index).select("segment", "slot", "object", "ordinal", "start", "end", "vector")
    retired = _table(spark, index, "manifest", MANIFEST).where("kind = 'retire'").count()
    generation = retired + _table(spark, index, "tombstones", TOMBSTONES).count()
    fresh, dead = segments.put(cut(passages), held, generation)
    # what is no longer there, and what changed until no passage of it was left
    empty = changed.select("object").join(passages.select("object"), "object", "left_anti")
    gone = segments.remove(held.select("object").distinct().join(notes.select("object"), "object", "left_anti").union(empty), held)
    fresh, dead = cut(fresh), cut(dead.unionByName(gone).distinct())
    bucket = F.pmod(F.xxhash64("segment"), F.lit(BUCKETS)).cast("int")
    columns = [c.split()[0] for c in ENTRIES.split(", ")]
    _append(fresh.withColumn("slot", F.col("slot").cast("int")).withColumn("bucket", bucket).select(*columns), index, "entries", "bucket")
    _append(dead.select("segment", F.col("slot").cast("int").alias("slot")), index, "tombstones")
    adds = fresh.groupBy("segment").agg(F.count(F.lit(1)).alias("count"))
    _append(adds.select(F.lit("add").alias("kind"), "segment", "count", F.lit(None).cast("string").alias("superseded_by")), index, "manifest")
    _append(changed.unionByName(lost).withColumn("turn", F.lit(turn).cast("long")), index, "notes")
    added = fresh.agg(F.count(F.lit(1)).alias("added"), F.count_distinct("object").alias("notes"))
    return added.crossJoin(dead.agg(F.count(F.lit(1)).alias("buried"))).crossJoin(changed.agg(F.count(F.lit(1)).alias("embedded")))


def ask(
    questions: DataFrame, notes: DataFrame, index: str, k: int = retrieval.K, floor: float = retrieval.FLOOR, dimension: int = DIMENSION
) -> DataFrame:
    """Passages and near misses for a stated set ``questions(q, question)``."""
    spark = questions.sparkSession
    live = entries(spark, index)
    asked = embedded(questions, "question", dimension).select("q", F.col("vector").alias("qv"))
    scored = search.scored(live.select("segment", "slot", "object", "start", "end", "kind", "link_ratio", "heading_path", "vector"), asked, retrieval.OVERFETCH * k)
    pool = retrieval.resolve(retrieval.candidates(scored, k), notes.select("object", "text"))
    return retrieval.retrieve(pool, k=k, floor=floor)


def evaluate(questions: DataFrame, notes: DataFrame, index: str, floor: float = retrieval.FLOOR) -> DataFrame:
    """One row for ``questions(q, question, expected)``; a null ``expected`` must be refused."""
    passages = ask(questions.select("q", "question"), notes, index, floor=floor).where("outcome = 'passage'")
    return retrieval.evaluation(questions.select("q", "expected"), passages.select("q", "place", "text"))


def topic_report(spark: SparkSession, index: str, k: int | None = None) -> DataFrame:
    live = cut(entries(spark, index).select("segment", "slot", "object", "start", "end", "vector"))
    centres = topics.fit(live, k)
    if not centres:
        return spark.createDataFrame([], "cluster int, chunks long, notes long, cohesion double, loose boolean")
    return topics.in_order(topics.topic_map(live, centres))


def stats(spark: SparkSession, index: str) -> DataFrame:
    every = _table(spark, index, "entries", ENTRIES)
    return manifest.index_stats(every.select("segment", "slot", "object"), _table(spark, index, "tombstones", TOMBSTONES))


def compact(spark: SparkSession, index: str, min_segments: int = 8, max_dead_percent: int = 20) -> DataFrame:
    """Merge the smallest tier where it is worth it; one row with how many segments went into how many rows."""
    dead = _table(spark, index, "tombstones", TOMBSTONES)
    every = _table(spark, index, "entries", ENTRIES).join(entries(spark, index).select("segment").distinct(), "segment", "left_semi")
    gone = dead.groupBy("segment").agg(F.count_distinct("slot").alias("dead"))
    sizes = every.groupBy("segment").agg(F.count(F.lit(1)).alias("count")).join(gone, "segment", "left").fillna(0, ["dead"])
    inputs = cut(manifest.plan_compaction(sizes, min_segments, max_dead_percent).select("segment"))
    rows, retired = segments.compact(every.drop("bucket"), dead, inputs)
    rows, retired = cut(rows), cut(retired)
    bucket = F.pmod(F.xxhash64("segment"), F.lit(BUCKETS)).cast("int")
    columns = [c.split()[0] for c in ENTRIES.split(", ")]
    _append(rows.withColumn("slot", F.col("slot").cast("int")).withColumn("bucket", bucket).select(*columns), index, "entries", "bucket")
    _append(retired.select(F.lit("retire").alias("kind"), "segment", F.lit(None).cast("long").alias("count"), "superseded_by"), index, "manifest")
    return rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(retired.agg(F.count(F.lit(1)).alias("segments")))


