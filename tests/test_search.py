"""Retrieval, manifest, log and topics on small tables with known answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import ann, chunker, manifest, oplog, retrieval, search, segments, topics
from marginalia.plans import more_queries, search_queries
from marginalia.session import chosen

POOL = "q long, segment int, slot long, score double, rk int, resolved boolean, link_ratio int"


def pool(spark, rows):
    return spark.createDataFrame([(0, 0, i, s, i + 1, r, l) for i, (s, r, l) in enumerate(rows)], POOL)


def outcome(spark, rows, **options):
    got = retrieval.retrieve(pool(spark, rows), **options).orderBy("outcome", "place").collect()
    return [(r.outcome, r.place, r.slot) for r in got]


def test_retrieval_stops_at_k_and_keeps_three_misses(spark):
    rows = [(0.9, True, 0), (0.8, False, 0), (0.7, True, 9000), (0.65, True, 0)] + [(0.3, True, 0)] * 5
    got = outcome(spark, rows, k=2)
    assert got == [("passage", 1, 0), ("passage", 2, 3)]
    got = outcome(spark, rows, k=3)
    assert got == [("near-miss", 1, 4), ("near-miss", 2, 5), ("near-miss", 3, 6), ("passage", 1, 0), ("passage", 2, 3)]


def test_one_demoted_passage_stands_in_for_none(spark):
    assert outcome(spark, [(0.9, True, 7000), (0.8, True, 8000), (0.1, True, 0)]) == [("near-miss", 1, 2), ("passage", 1, 0)]


def test_relative_floor_needs_a_positive_best(spark):
    assert outcome(spark, [(-0.1, True, 0), (-0.2, True, 0)], floor=-1.0) == [("passage", 1, 0), ("passage", 2, 1)]


def test_shape_of_one_candidate(spark):
    r = retrieval.retrieval_shape(pool(spark, [(0.5, True, 0)])).first()
    assert (r.candidates, r.best, r.second_score, r.gap, r.standout) == (1, 0.5, 0.5, 0.0, 0.0)


def test_evaluation_counts_refusals(spark):
    asked = spark.createDataFrame([(1, "cat"), (2, "dog"), (3, None), (4, None)], "q long, expected string")
    given = spark.createDataFrame([(1, 1, "a bird"), (1, 2, "a cat"), (3, 1, "x")], "q long, place int, text string")
    r = retrieval.evaluation(asked, given).first()
    assert (r.asked, r.answerable, r.hit1, r.hit3, r.hit5, r.refusals, r.correct_refusals) == (4, 2, 0, 1, 1, 2, 1)
    assert r.mrr == pytest.approx(0.25)


def test_answers_fail_closed(spark):
    replies = ["VERDICT: ANSWER\nyes [1]", "VERDICT: ANSWER\nyes", "yes [1]", "VERDICT: NO-ANSWER\n[1]", None, "## verdict: answer\n[9] [2][2]"]
    table = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    from pyspark.sql import functions as F

    status = retrieval.answer_status(F.lit(True), F.lit(2), F.lit(True), F.col("reply"))
    assert [r[0] for r in table.orderBy("i").select(status).collect()] == ["answered", "ungrounded", "no-answer-in-passages", "no-answer-in-passages", "generation-failed", "answered"]


def test_many_queries_are_worked_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(0, i, [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "segment int, slot long, vector array<double>")
    asked = vectors.selectExpr("slot AS q", "vector AS qv")
    whole = sorted(search.topk(search.scored(vectors, asked), 3).collect())
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert sorted(search.topk(search.scored(vectors, asked), 3).collect()) == whole and len(whole) == 90


def test_codes_find_what_exact_search_finds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16)) + np.repeat(rng.normal(size=(9, 16)) * 3, 100, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i % 3, i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows + [(0, 5000, None), (0, 5001, [1.0])], "segment int, slot long, vector array<double>")
    asked = vectors.where("slot % 10 = 0 AND vector IS NOT NULL").selectExpr("slot AS q", "vector AS qv")
    for chunk, block in ((32_768, 2_048), (50, 7)):
        monkeypatch.setattr(ann, "CHUNK", chunk)
        monkeypatch.setattr(ann, "BLOCK", block)
        book = ann.fit(vectors, cells=9, stretches=8)
        index = ann.build(vectors, book)
        assert index.count() == 900 and index.select("cell").distinct().count() == 9
        exact = search.topk(search.scored(vectors.where("slot < 5000"), asked), 10)
        r = retrieval.recall(ann.search(index, vectors, asked, book, 3, 10, 60), exact).first()
        assert r.identity_recall > 0.95 and r.score_recall > 0.95
        every = ann.search(index, vectors, asked, book, 9, 10, 900)
        assert retrieval.recall(every, exact).first().identity_recall == 1.0
    # the dead are no hits, and don't take the place of any
    dead = vectors.where("slot % 2 = 0").select("segment", "slot")
    left = search.topk(search.scored(vectors.where("slot % 2 = 1 AND slot < 5000"), asked), 10)
    got = ann.search(index, vectors, asked, book, 9, 10, 450, dead)
    rows = lambda d: sorted((r.q, r.rk, r.slot) for r in d.collect())
    assert rows(got) == rows(left)


def test_codes_of_equal_few_or_no_vectors(spark):
    schema = "segment int, slot long, vector array<double>"
    same = spark.createDataFrame([(0, i, [1.0, 0.0, 0.5]) for i in range(7)], schema)
    asked = same.selectExpr("slot AS q", "vector AS qv").where("q = 3")
    book = ann.fit(same)
    assert [r.slot for r in ann.search(ann.build(same, book), same, asked, book, 1, 4).orderBy("rk").collect()] == [0, 1, 2, 3]
    assert ann.search(ann.build(same, book), same, asked, book, 1, 20).count() == 7
    nothing = same.limit(0)
    assert ann.fit(nothing) is None
    assert ann.search(ann.build(nothing, None), nothing, asked, None, 1, 4).count() == 0
    assert ann.search(ann.build(same, book), same, asked.limit(0), book, 1, 4).count() == 0


def test_topics_are_stable_and_add_up(spark):
    rng = np.random.default_rng(2)
    centre = np.eye(6)
    x = np.concatenate([centre[k] + rng.normal(scale=0.1, size=(20, 6)) for k in range(3)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i % 4, i, v.tolist(), i // 3, i) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "segment int, slot long, vector array<double>, object long, start long")
    centres = topics.fit(vectors, k=3)
    assert np.allclose(topics.fit(vectors.repartition(5), k=3), centres)
    report = topics.in_order(topics.topic_map(vectors, centres)).collect()
    assert [r.chunks for r in report] == [20, 20, 20] and all(not r.loose and len(r.examples) == 3 for r in report)
    assert [topics.default_count(n) for n in (0, 1, 2, 3, 4, 50, 10**6)] == [0, 0, 2, 2, 2, 5, 20]


OPS = "counter long, replica string, kind string, segment string, count long, bytes long, model string, slot int, superseded_by string"


def test_manifest_folds_alike_in_any_order(spark):
    ops = [
        (1, "a", "add", "s1", 4, 40, "m", None, None), (2, "a", "add", "s2", 3, 30, "m", None, None), (3, "b", "tombstone", "s1", None, None, None, 2, None),
        (4, "b", "tombstone", "s3", None, None, None, 0, None), (5, "a", "retire", "s1", None, None, None, None, "s2"), (6, "c", "add", "s4", 9, 9, "other", None, None),
        (7, "c", "add", "s1", 4, 41, "m", None, None), (0, "x", "add", "bad", 1, 1, "m", None, None), (8, "x", "add", "bad", 0, 1, "m", None, None),
    ]
    rng, seen = random.Random(0), set()
    from pyspark.sql import functions as F

    for _ in range(3):
        rng.shuffle(ops)
        state = manifest.fold(spark.createDataFrame(ops + ops[:4], OPS), F.lit("m"))
        seen.add(tuple(sorted((r.segment, r["count"], r.bytes, r.added_at, tuple(r.dead), tuple(r.superseded_by)) for r in state.collect())))
    assert seen == {(("s1", 4, 40, 1, (2,), ("s2",)), ("s2", 3, 30, 2, (), ()), ("s3", None, None, None, (0,), ()))} or len(seen) == 1
    names = lambda d: sorted(r.segment for r in d.collect())
    here = lambda *s: spark.createDataFrame([(x,) for x in s], "segment string")
    assert names(manifest.live(state, here("s1", "s2"))) == ["s2"] and names(manifest.live(state, here("s1"))) == ["s1"]
    assert names(manifest.droppable(state, here("s1", "s2"))) == ["s1"] and names(manifest.awaiting(state, here("s1"))) == ["s1"]
    assert names(manifest.missing(state, here("s2"))) == [] and names(manifest.missing(state, here("s1"))) == ["s2"]


def test_compaction_takes_the_smallest_tier(spark):
    table = spark.createDataFrame([("a", 10, 0), ("b", 35, 9), ("c", 40, 0), ("d", 500, 400)], "segment string, count long, dead long")
    assert sorted(r.segment for r in manifest.plan_compaction(table, 3, 50).collect()) == ["a", "b", "c"]
    assert manifest.plan_compaction(table, 4, 50).count() == 0
    assert {r.reason for r in manifest.plan_compaction(table, 4, 10).collect()} == {"dead ratio"}
    assert manifest.plan_compaction(table.where("segment = 'a'"), 1, 0).count() == 0


def test_put_is_idempotent_and_buries_old_entries(spark):
    kinds = "object string, ordinal int, start int, end int, vector array<double>"
    v1 = spark.createDataFrame([("x", 0, 0, 5, [1.0]), ("x", 1, 5, 9, [2.0])], kinds)
    empty = spark.createDataFrame([], "segment string, slot int, " + kinds)
    added, dead = segments.put(v1, empty)
    assert added.count() == 2 and dead.count() == 0
    again, dead = segments.put(v1, added)
    assert again.count() == 0 and dead.count() == 0
    v2 = spark.createDataFrame([("x", 0, 0, 5, [3.0])], kinds)
    changed, dead = segments.put(v2, added, 1)
    assert changed.count() == 1 and dead.count() == 2
    back, _ = segments.put(v1, changed, 3)
    assert back.first().segment != added.first().segment


def test_compact_renumbers_live_entries(spark):
    entries = spark.createDataFrame([("a", i, f"o{i}") for i in range(3)] + [("b", i, f"p{i}") for i in range(2)], "segment string, slot int, object string")
    dead = spark.createDataFrame([("a", 1)], "segment string, slot int")
    inputs = spark.createDataFrame([("a",), ("b",)], "segment string")
    rows, retired = segments.compact(entries, dead, inputs)
    got = sorted((r.slot, r.object) for r in rows.collect())
    assert got == [(0, "o0"), (1, "o2"), (2, "p0"), (3, "p1")]
    assert sorted(r.segment for r in retired.collect()) == ["a", "b"] and len({r.superseded_by for r in retired.collect()}) == 1


def test_watermark_waits_for_every_device(spark):
    reports = spark.createDataFrame([("d1", 100, {"d1": 50, "d2": 40}), ("d2", 100, {"d1": 45, "d2": 60})], "device string, clock long, have map<string,bigint>")
    devices = lambda *d: spark.createDataFrame([(x,) for x in d], "device string")
    produced = spark.createDataFrame([("d1",), ("d2",)], "replica string")
    mark = lambda d: oplog.compaction_watermark(reports, d, produced).first().watermark
    assert mark(devices("d1", "d2")) == 40 and mark(devices("d1", "d2", "d3")) == 0 and mark(devices().limit(0)) == 0
    slow = spark.createDataFrame([("d1", 100, {"d1": 50, "d2": 40}), ("d2", 10, {"d1": 45, "d2": 60})], reports.schema)
    assert oplog.compaction_watermark(slow, devices("d1", "d2"), produced).first().watermark == 10


def test_registered_status_queries_look_at_the_end_of_a_text(spark, monkeypatch, tmp_path):
    rows = [(1, "a" * 300), (2, "a" * 300 + "é"), (3, "a" * 300), (4, "é" * 500), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert dict(more_queries.flt_utf8(spark, str(tmp_path)).collect()) == {1: True, 2: True, 3: False, 4: True, 5: True}
    monkeypatch.setattr(chunker, "MAX_DOCUMENT", 600)
    got = dict(more_queries.chunk_status(spark, str(tmp_path)).collect())
    assert got == {1: "ok", 2: "ok", 3: "not-utf8", 4: "too-large", 5: "ok"}


def test_the_registered_topic_map_fits_with_the_default_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(topics, "fit", lambda vectors, k=None, iterations=topics.ITERATIONS: asked.append(iterations) or [[1.0] * 64, [-1.0] * 64])
    search_queries.topic_map(spark, "/root/testdata/sf0.001")
    assert asked == [topics.ITERATIONS]


def test_samples_keep_their_size_whatever_the_number_of_rows(spark):
    """A share far below one in a million still draws rows."""
    ids = spark.range(2_000_000).select(F.xxhash64("id").alias("h"))
    for limit, n in ((50, 2_000_000), (100, 10**15), (3, 2), (5, 0)):
        got = ids.where(chosen(F.col("h"), limit, n)).count()
        want = min(limit / max(n, 1), 1.0) * 2_000_000
        assert abs(got - want) <= 6 * max(want, 1) ** 0.5
    assert ids.where(chosen(F.col("h"), 10**14, 10**20)).count() > 0


def test_adds_must_agree_with_the_earliest(spark):
    schema = "counter long, replica string, kind string, segment string, count long, bytes long, model string, slot int, superseded_by string"
    add = lambda c, r, s, n: (c, r, "add", s, n, 1, "m", None, None)
    ops = spark.createDataFrame([add(5, "b", "s", 3), add(2, "a", "s", 4), add(9, "c", "s", 4), add(1, "a", "t", 2), (3, "a", "tombstone", "s", None, None, None, 0, None)], schema)
    assert [tuple(r) for r in manifest.conflicting(ops).collect()] == [(5, "b", "s", 3, 4)]
    assert sorted(r.counter for r in manifest.agreeing(ops).collect()) == [1, 2, 3, 9]


def test_topics_are_named_by_whatever_replies(spark):
    example = "array<struct<rk:int,object:string,start:int,similarity:double>>"
    found = spark.createDataFrame([(0, [(2, "b", 0, 0.8), (1, "a", 5, 0.9)]), (1, [(1, "c", 0, 0.7)]), (2, [(1, "a", 5, 0.5)]), (3, [])], f"cluster int, examples {example}")
    passages = spark.createDataFrame([("a", 5, "first"), ("b", 0, "second"), ("a", 0, "elsewhere"), ("c", 0, "")], "object string, start int, text string")
    asked = []

    def reply(question, excerpts):
        asked.append(question)
        return F.when(F.col("cluster") == 2, F.lit(' *"#')).otherwise(F.concat(F.lit('"**'), F.translate(excerpts, "\n", "_"), F.lit('."\nmore')))

    got = {r.cluster: r.label for r in topics.labelled(found, passages, reply).collect()}
    assert got == {0: "first_---_second_---_", 1: None, 2: None, 3: None} and len(asked) == 1


def test_scores_by_groups_are_those_of_all_pairs(spark, monkeypatch):
    """Odd vectors, ties and floors, in groups of a few: as one expression over the cross product has them."""
    rng = np.random.default_rng(3)
    same, inf, nan = [1.0, 2.0, 2.0], float("inf"), float("nan")
    odd = [same] * 9 + [None, [], [1.0], [1.0, None, 2.0], [nan, 0.0, 1.0], [inf, 1.0, 1.0], [-inf, 1.0, 1.0], [0.0, -0.0, 0.0]]
    rows = [(i % 3 or None, i, v) for i, v in enumerate(odd + rng.normal(size=(40, 3)).tolist())]
    vectors = spark.createDataFrame(rows, "segment int, slot long, vector array<double>")
    asked = vectors.where("vector IS NOT NULL AND slot % 2 = 0").selectExpr("slot AS q", "vector AS qv")
    product = vectors.crossJoin(asked).select("segment", "slot", "q", F.expr(
        "CASE WHEN size(vector) = size(qv) THEN aggregate(zip_with(vector, qv, (x, y) -> x * y), 0D, (a, x) -> a + x) ELSE 0D END AS score"))
    shown = lambda d: sorted(str(r.asDict()) for r in d.select("q", "segment", "slot", "score", *[c for c in d.columns if c == "rk"]).collect())
    monkeypatch.setattr(search, "CHUNK", 13)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(search, "ASKED", 4)
    assert shown(search.scored(vectors, asked)) == shown(product)
    for k in (1, 5):
        assert shown(search.topk(search.scored(vectors, asked, k), k)) == shown(search.topk(product, k))
        assert shown(search.topk_per_segment(search.scored(vectors, asked, k, per_segment=True), k)) == shown(search.topk_per_segment(product, k))
        others = search.scored(vectors, asked, k, apart=True)
        assert shown(search.topk(others, k)) == shown(search.topk(product.where("q <> slot"), k))
    high = search.scored(vectors, asked.withColumn("least", F.lit(0.5)))
    assert shown(high.where("score >= 0.5")) == shown(product.where("score >= 0.5"))
    # what leaves a group is bounded by the questions, not by the pairs
    assert search.scored(vectors, asked, 1).count() < product.count() / 3
    assert search.scored(vectors.limit(0), asked, 1).count() == search.scored(vectors, asked.limit(0)).count() == 0


@pytest.mark.parametrize("per_segment", [False, True])
def test_pairs_that_cannot_be_among_the_first_are_not_added_up(spark, per_segment):
    """Near ties, equal vectors and long ones: what the rough product leaves out is never among the first."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(40, 8))
    x = np.concatenate([base, base, base * (1 + 1e-16), base + rng.normal(size=base.shape) * 1e-16, base * 1e8])
    rows = [(i % 3, i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "segment int, slot long, vector array<double>")
    asked = vectors.where("slot % 7 = 0").selectExpr("slot AS q", "vector AS qv")
    rank = search.topk_per_segment if per_segment else search.topk
    some = search.scored(vectors, asked, 5, per_segment)
    assert sorted(rank(some, 5).collect()) == sorted(rank(search.scored(vectors, asked), 5).collect())
    assert some.count() < 200 * asked.count() / 2
    floors = asked.join(search.scored(vectors, asked).where("segment = 1 AND slot % 4 = 0").groupBy("q").agg(F.max("score").alias("least")), "q")
    above = search.scored(vectors, asked).join(floors.select("q", "least"), "q").where("score >= least").drop("least")
    assert sorted(search.scored(vectors, floors).select(above.columns).collect()) == sorted(above.collect())


def test_few_pairs_are_added_up_one_by_one(monkeypatch):
    rng = np.random.default_rng(2)
    x, asked, added = rng.normal(size=(500, 16)), rng.normal(size=(20, 16)), []
    whole, single = search._dots(asked, np.ascontiguousarray(x.T)), search._pairs
    monkeypatch.setattr(search, "_pairs", lambda *a: added.append(len(a[2])) or single(*a))
    axes = np.ascontiguousarray(x.T)
    rows, cols, scores = search._near(asked, axes, search._slack(asked, axes), [0, 500], 3, None, np.zeros((20, 500), bool))
    want = np.argsort(-whole, axis=1, kind="stable")[:, :3]
    assert added == [60] and (np.sort(want, axis=1) == cols.reshape(20, 3)).all() and (scores == whole[rows, cols]).all()


def test_rounded_scores_are_those_of_decimals(spark):
    values = [0.0, -0.0, -1e-9, 0.1234565, -0.1234565, 2.5e-6, 0.0000005, -0.0000005, 1e7, 1e300, float("nan"), float("inf"), None, 0.25, 0.9999995]
    values += [float(v) for v in np.round(np.random.default_rng(3).normal(size=500), 7)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6).alias("a"), search.rounded(F.col("x")).alias("b")).collect()
    assert [repr(r.a) for r in got] == [repr(r.b) for r in got]


def test_a_question_reads_as_many_vectors_as_its_answers_ask_for(spark, monkeypatch):
    monkeypatch.setattr(search_queries, "RERANK", 10)
    row = search_queries.idx_ann_search(spark, "/root/testdata/sf0.01").first()
    assert row.held and row.hits == 10 * row.questions
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    vectors = spark.createDataFrame([(i % 3, i, v.tolist()) for i, v in enumerate(x)], "segment int, slot long, vector array<double>")
    asked = vectors.where("slot % 30 = 0").select(F.col("slot").alias("q"), F.col("vector").alias("qv"))
    book = ann.fit(vectors, cells=9, stretches=4)
    index = ann.build(vectors, book)
    probes, rerank = ann.settled(index, vectors, asked, book, 9, 5, 6)
    assert probes == 9 and 6 < rerank < 1500
    share = retrieval.recall(ann.search(index, vectors, asked, book, probes, 5, rerank), search.topk(search.scored(vectors, asked, 5), 5)).first().identity_recall
    assert share >= ann.SHARE
    assert ann.settled(index, vectors, asked, book, 1, 5, 6)[0] == 9


def test_where_any_pair_goes_on_no_vector_is_shuffled_for_each_block(spark, monkeypatch):
    for name, most in (("TOLD", 7), ("SHARE", 16), ("HELD", 50), ("HELD_ABOVE", 50)):
        monkeypatch.setattr(search, name, most, raising=False)
    rng = np.random.default_rng(4)
    rows = [(i % 3, i, v.tolist() if i % 10 else None) for i, v in enumerate(rng.normal(size=(60, 4)))]
    vectors = spark.createDataFrame(rows, "segment int, slot long, vector array<double>")
    asked = vectors.where("slot % 2 = 1").select(F.col("slot").alias("q"), F.col("vector").alias("qv"))
    got = search.scored(vectors, asked)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Generate explode" not in plan
    held = {i: v for _, i, v in rows if v}
    assert {(r.q, r.slot): round(r.score, 9) for r in got.collect() if r.slot in held} == {(q, i): round(float(np.dot(held[q], v)), 9) for q in held if q % 2 for i, v in held.items()}
    above = search.scored(vectors, asked.withColumn("least", F.lit(0.5)), apart=True)
    assert {(r.q, r.slot) for r in above.collect()} == {(q, i) for q in held if q % 2 for i, v in held.items() if i != q and np.dot(held[q], v) >= 0.5}
    assert search.scored(vectors, asked.limit(0)).count() == 0 and search.scored(vectors.limit(0), asked).count() == 0
