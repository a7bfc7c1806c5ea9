"""Search over the ``embeddings`` table: segment is the label, slot the vector id.

The questions are the vectors whose id is divisible by 20. A hit's document is the one
with the slot as its id, and its passage the whole text; a hit is resolved where there
is one. The stand-in for the link ratio is arithmetic on the slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.vectors import dot
from marginalia.operators import ann, retrieval, search, topics
from marginalia.session import cut, table

K, FLOOR = 6, 0.25


def live_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("segment"), F.col("vec_id").alias("slot"), F.col("embedding").alias("vector")
    )


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated questions: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("q"), F.col("embedding").alias("qv")
    )


def scores(spark: SparkSession, sf_dir: str, best: int | None = None, per_segment: bool = False, apart: bool = False) -> DataFrame:
    """All pairs, or with ``best`` those that the first so many of a question are among."""
    return search.scored(live_vectors(spark, sf_dir), question_vectors(spark, sf_dir), best, per_segment, apart)


def scores_above(spark: SparkSession, sf_dir: str, questions: DataFrame) -> DataFrame:
    """Pairs that are not below the floor ``least`` of their question."""
    return search.scored(live_vectors(spark, sf_dir), questions)


def best_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir, 1).groupBy("q").agg(F.max("score").alias("best"))


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("q", F.col("slot").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


def topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.topk(scores(spark, sf_dir, 10), 10))


def topk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(search.topk_merged(scores(spark, sf_dir, 10, per_segment=True), 10))


def win_rank_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = search.topk_per_segment(scores(spark, sf_dir, 3, per_segment=True), 3)
    return ranked.select("q", "segment", F.col("slot").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rk").cast("long").alias("rk"))


def join_query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("q", F.col("slot").alias("vec_id"), search.rounded(F.col("score")).alias("score"))


def flt_score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_above(spark, sf_dir, question_vectors(spark, sf_dir).withColumn("least", F.lit(FLOOR))).where(F.col("score") >= FLOOR).select("q", F.col("slot").alias("vec_id"), search.rounded(F.col("score")).alias("score"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.candidates(scores(spark, sf_dir, retrieval.OVERFETCH * K), K)
    hits = hits.withColumn("object", F.col("slot")).withColumn("start", F.lit(0))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object"), "text")
    ends = documents.select("object", F.octet_length("text").alias("end"))
    return retrieval.resolve(hits.join(ends, "object", "left"), documents).withColumn("link_ratio", F.col("slot") * 37 % 8000)


def join_hit_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = pool(spark, sf_dir)
    return hits.select("q", F.col("slot").alias("vec_id"), F.col("rk").cast("long").alias("rk"), "resolved", F.when(F.col("text").isNotNull(), F.col("end") - F.col("start")).otherwise(0).cast("long").alias("passage_bytes"))


def topk_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieval.retrieve(pool(spark, sf_dir), k=K, floor=FLOOR)
    return got.select("q", F.col("slot").alias("vec_id"), F.round("score", 6).alias("score"), "outcome", F.col("place").cast("long").alias("place"))


def topk_near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_retrieve(spark, sf_dir).where("outcome = 'near-miss'").select("q", "vec_id", "score", "place")


def flt_relative_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cut(best_scores(spark, sf_dir))
    least = F.when(F.col("best") > 0, F.greatest(F.col("best") * 0.3, F.lit(-2.0))).otherwise(-2.0)
    asked = question_vectors(spark, sf_dir).join(best.withColumn("least", least).drop("best"), "q")
    kept = scores_above(spark, sf_dir, asked).join(best, "q").where(~retrieval.below_floor(F.col("score"), F.col("best"), -2.0, 0.3))
    return kept.select("q", F.col("slot").alias("vec_id"), search.rounded(F.col("score")).alias("score"))


def agg_retrieval_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = retrieval.retrieval_shape(retrieval.candidates(scores(spark, sf_dir, retrieval.OVERFETCH * K), K))
    return shape.select("q", "candidates", *[F.round(c, 6).alias(c) for c in ("best", "second_score", "mean", "stddev", "gap", "standout")])


def agg_score_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = retrieval.score_spread(search.topk(scores(spark, sf_dir, K), K))
    return spread.select("q", F.round("spread", 6).alias("spread"), "barely_apart")


def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanics on the vectors: a question expects the label of its own vector, one in five must be refused."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), F.when(F.col("vec_id") % 100 != 0, F.concat(F.lit("#"), F.col("label"), F.lit("#"))).alias("expected")
    )
    ranked = search.scored(live_vectors(spark, sf_dir), asked.select("q", "qv"), 5, apart=True).where("q <> slot")
    given = search.topk(ranked, 5).where(F.col("score") >= 0.3)
    passages = given.select("q", F.col("rk").alias("place"), F.concat(F.lit("#"), F.col("segment"), F.lit("#")).alias("text"))
    return retrieval.evaluation(asked.select("q", "expected"), passages).withColumn("mrr", F.round("mrr", 6))


#: Cells, how many of them a question probes, and how many vectors it reads at the least. The test vectors are spread almost evenly, so that few cells can be left out.
CELLS, PROBES, RERANK = 16, 15, 80


def _codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ann.Codebook]:
    """The index of all vectors, written once."""
    live = live_vectors(spark, sf_dir)
    book = ann.fit(live, cells=CELLS)
    return cut(ann.build(live, book)), book


def _approximate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The answers, and how many vectors a question reads for them."""
    (index, book), live, asked = _codes(spark, sf_dir), live_vectors(spark, sf_dir), question_vectors(spark, sf_dir)
    probes, rerank = ann.settled(index, live, asked, book, PROBES, 10, RERANK)
    return ann.search(index, live, asked, book, probes, 10, rerank), rerank


def idx_ann_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of each segment in the index, and the bytes of their codes."""
    index, _ = _codes(spark, sf_dir)
    return index.groupBy("segment").agg(F.count(F.lit(1)).alias("vectors"), F.sum(F.octet_length("codes")).cast("long").alias("code_bytes"))


def eval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the exact answers is found, and what share of the vectors a question reads for it."""
    found, read = _approximate(spark, sf_dir)
    n = F.lit(read) / F.lit(max(live_vectors(spark, sf_dir).count(), 1))
    return retrieval.recall(found, search.topk(scores(spark, sf_dir, 10), 10)).withColumn("vectors_read", F.least(n, F.lit(1.0)))


def idx_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether at least 0.95 of the exact answers are found."""
    found = cut(_approximate(spark, sf_dir)[0])
    ok = retrieval.recall(found, search.topk(scores(spark, sf_dir, 10), 10)).select((F.col("score_recall") >= 0.95).alias("held"))
    return found.agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("q").alias("questions")).crossJoin(F.broadcast(ok))


def topk_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_approximate(spark, sf_dir)[0])


def agg_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of each label's vectors to their normalised sum."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), "vec_id", F.col("embedding").cast("array<double>").alias("_v"))
    sums = topics.centroids(rows)
    scored = rows.join(sums, "cluster").withColumn("s", dot(F.col("_v"), F.col("sums")) / F.sqrt(dot(F.col("sums"), F.col("sums"))))
    return scored.groupBy(F.col("cluster").alias("label")).agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("s"), 6).alias("cohesion"))


def win_topic_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), "vec_id", F.col("embedding").cast("array<double>").alias("_v"))
    sums = topics.centroids(rows)
    scored = rows.join(sums, "cluster").withColumn("score", dot(F.col("_v"), F.col("sums")) / F.sqrt(dot(F.col("sums"), F.col("sums"))))
    ranked = scored.select(F.col("cluster").alias("q"), F.lit(0).alias("segment"), F.col("vec_id").alias("slot"), "score")
    return search.topk(ranked, 3).select(F.col("q").alias("label"), F.col("slot").alias("vec_id"), F.round("score", 6).alias("similarity"), F.col("rk").cast("long").alias("rk"))


def topic_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = live_vectors(spark, sf_dir)
    centres = topics.fit(live)
    notes = live.withColumn("object", F.col("slot") % 100).withColumn("start", F.col("slot"))
    shown = F.array_join(F.transform("examples", lambda e: e["start"].cast("string")), ",")
    report = topics.topic_map(notes, centres)
    return report.select("cluster", "chunks", "notes", F.round("cohesion", 6).alias("cohesion"), "loose", shown.alias("examples"))


def fold_kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment to the first four vectors as centres, rolled up."""
    live = live_vectors(spark, sf_dir)
    centres = [list(map(float, r["vector"])) for r in live.where("slot < 4").orderBy("slot").collect()]
    points = live.select("segment", "slot", F.col("vector").cast("array<double>").alias("_v"))
    placed = topics.assign(points, centres)
    return placed.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.col("slot") % 100).alias("notes"), F.round(F.avg("similarity"), 6).alias("cohesion")
    )


SCORED = """
WITH s AS (
  SELECT b.vec_id AS q, a.label AS segment, a.vec_id AS slot,
         list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
  FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) b),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, segment, slot) AS rk FROM s)
"""
POOL = SCORED + """
, p AS (
  SELECT k.*, d.text IS NOT NULL AS resolved, d.text, slot * 37 % 8000 AS link_ratio, max(score) OVER (PARTITION BY q) AS best
  FROM k LEFT JOIN documents d ON d.doc_id = k.slot WHERE rk <= 18),
f AS (SELECT *, score < 0.25 OR (best > 0 AND score < best * 0.55) AS miss FROM p),
g AS (SELECT *, NOT miss AND resolved AND link_ratio < 6000 AS clear, NOT miss AND resolved AND link_ratio >= 6000 AS demoted FROM f),
h AS (
  SELECT *, coalesce(sum(clear::INT) OVER (PARTITION BY q ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS kept_before,
         sum(miss::INT) OVER (PARTITION BY q ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS miss_no,
         sum(demoted::INT) OVER (PARTITION BY q ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS demoted_no,
         sum(clear::INT) OVER (PARTITION BY q) AS kept_all FROM g),
r AS (
  SELECT q, slot AS vec_id, round(score, 6) AS score, 'passage' AS outcome,
         CASE WHEN clear THEN kept_before + 1 ELSE 1 END::BIGINT AS place
  FROM h WHERE (clear AND kept_before < 6) OR (demoted AND demoted_no = 1 AND kept_all = 0)
  UNION ALL
  SELECT q, slot, round(score, 6), 'near-miss', miss_no::BIGINT FROM h WHERE miss AND kept_before < 6 AND miss_no <= 3)
"""
SUMS = """
WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
a AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS axis FROM e),
t AS (SELECT label, axis, sum(x) AS x FROM a GROUP BY label, axis),
c AS (SELECT label, list(x ORDER BY axis) AS sums FROM t GROUP BY label),
z AS (SELECT e.label, e.vec_id, list_dot_product(e.v, c.sums) / sqrt(list_dot_product(c.sums, c.sums)) AS s FROM e JOIN c USING (label))
"""

QUERIES = {
    f.__name__: f
    for f in (
        topk_exact, topk_merge, win_rank_segment, join_query_vectors, flt_score_floor, join_hit_document, topk_retrieve, topk_near_misses,
        flt_relative_floor, agg_retrieval_shape, agg_score_spread, eval_retrieval, eval_recall, topk_ann, idx_ann_build, idx_ann_search, agg_centroid, win_topic_examples,
        topic_map, fold_kmeans_step,
    )
}
ORACLES = {
    "idx_ann_build": "SELECT label AS segment, count(*) AS vectors, count(*) * 16 AS code_bytes FROM embeddings GROUP BY 1",
    "idx_ann_search": """
SELECT 10 * count(*) AS hits, count(*) AS questions, true AS held FROM embeddings WHERE vec_id % 20 = 0""",
    "topk_exact": SCORED + "SELECT q, slot AS vec_id, round(score, 6) AS score, rk FROM k WHERE rk <= 10",
    "topk_merge": SCORED + "SELECT q, slot AS vec_id, round(score, 6) AS score, rk FROM k WHERE rk <= 10",
    "win_rank_segment": SCORED + """
SELECT q, segment, slot AS vec_id, round(score, 6) AS score, n AS rk FROM (
  SELECT *, row_number() OVER (PARTITION BY q, segment ORDER BY score DESC, slot) AS n FROM s) WHERE n <= 3""",
    "join_query_vectors": SCORED + "SELECT q, slot AS vec_id, round(score, 6) AS score FROM s",
    "flt_score_floor": SCORED + "SELECT q, slot AS vec_id, round(score, 6) AS score FROM s WHERE score >= 0.25",
    "join_hit_document": POOL + "SELECT q, slot AS vec_id, rk, resolved, CASE WHEN resolved THEN strlen(text) ELSE 0 END AS passage_bytes FROM p",
    "topk_retrieve": POOL + "SELECT * FROM r",
    "topk_near_misses": POOL + "SELECT q, vec_id, score, place FROM r WHERE outcome = 'near-miss'",
    "flt_relative_floor": SCORED + """
SELECT q, slot AS vec_id, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM s)
WHERE NOT (best > 0 AND score < best * 0.3) AND score >= -2""",
    "agg_retrieval_shape": SCORED + """
, p AS (SELECT * FROM k WHERE rk <= 18),
x AS (SELECT q, count(*) AS candidates, max(score) AS best, coalesce(max(score) FILTER (rk = 2), max(score)) AS second_score,
             avg(score) AS mean, stddev_pop(score) AS stddev FROM p GROUP BY q)
SELECT q, candidates, round(best, 6) AS best, round(second_score, 6) AS second_score, round(mean, 6) AS mean, round(stddev, 6) AS stddev,
       round(best - second_score, 6) AS gap, round(CASE WHEN stddev > 0 THEN (best - mean) / stddev ELSE 0 END, 6) AS standout FROM x""",
    "agg_score_spread": SCORED + """
SELECT q, round(max(score) - min(score), 6) AS spread, max(score) - min(score) < 0.05 AS barely_apart FROM k WHERE rk <= 6 GROUP BY q""",
    "eval_retrieval": """
WITH asked AS (SELECT vec_id AS q, embedding, CASE WHEN vec_id % 100 <> 0 THEN label END AS expected FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q, expected, a.label, a.vec_id AS slot, list_dot_product(a.embedding::DOUBLE[], asked.embedding::DOUBLE[]) AS score
      FROM embeddings a CROSS JOIN asked WHERE a.vec_id <> q),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, label, slot) AS rk FROM s),
g AS (SELECT * FROM k WHERE rk <= 5 AND score >= 0.3),
e AS (SELECT asked.q, asked.expected, min(rk) FILTER (g.label = asked.expected) AS rank, count(g.rk) AS given
      FROM asked LEFT JOIN g ON g.q = asked.q GROUP BY asked.q, asked.expected)
SELECT count(*) AS asked, count(expected) AS answerable, count(*) FILTER (expected IS NOT NULL AND rank <= 1) AS hit1,
       count(*) FILTER (expected IS NOT NULL AND rank <= 3) AS hit3, count(*) FILTER (expected IS NOT NULL AND rank <= 5) AS hit5,
       round(sum(CASE WHEN expected IS NOT NULL THEN coalesce(1.0::DOUBLE / rank, 0) END) / greatest(count(expected), 1), 6) AS mrr,
       count(*) FILTER (given = 0) AS refusals, count(*) FILTER (given = 0 AND expected IS NULL) AS correct_refusals FROM e""",
    "agg_centroid": SUMS + "SELECT label, count(*) AS chunks, round(avg(s), 6) AS cohesion FROM z GROUP BY label",
    "win_topic_examples": SUMS + """
SELECT label, vec_id, round(s, 6) AS similarity, rk FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rk FROM z) WHERE rk <= 3""",
    "fold_kmeans_step": """
WITH s AS (SELECT a.vec_id AS slot, b.vec_id AS cluster, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
           FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id < 4) b),
m AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY score DESC, cluster) AS rk FROM s)
SELECT cluster, count(*) AS chunks, count(DISTINCT slot % 100) AS notes, round(avg(score), 6) AS cohesion FROM m WHERE rk = 1 GROUP BY cluster""",
}
