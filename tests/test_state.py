"""Streams that look back: whatever order rows arrive in, and over restarts, they come to what a fold of everything gives."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.operators import text_crdt, tree
from marginalia.plans import log_queries, state_queries, stream_queries
from marginalia.session import shared_dir
from marginalia.streaming import flows, stateful

SF = "/root/testdata/sf0.001"
MOVE = "vault string, counter long, replica string, child string, parent string, name string, is_dir boolean"


@pytest.fixture
def base(spark):
    return f"{shared_dir(spark).rstrip('/')}/test-{uuid.uuid4().hex}"


def lay(rows, path, files):
    """``files`` lists of rows, written one after the other."""
    for part in files:
        rows.sparkSession.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(path)


def tree_of(rows):
    return sorted(tuple(r) for r in rows.select("vault", "child", "parent", "name", "is_dir").collect())


@pytest.mark.parametrize("order", ["forwards", "backwards", "shuffled"])
def test_late_moves_come_to_the_fold(spark, base, order):
    rng = random.Random(5)
    named = ["root", "trash", "d", "e", "f", "g", "h"]
    rows = [(v, c, rng.choice("ab"), rng.choice(named[2:]), rng.choice(named), rng.choice(["n", "m", ""]), True) for v in ("v", "w") for c in rng.sample(range(1, 2000), 90)]
    moves = spark.createDataFrame(rows, MOVE)
    arrive = sorted(rows, key=lambda r: r[1], reverse=order == "backwards")
    if order == "shuffled":
        rng.shuffle(arrive)
    third = len(arrive) // 3
    lay(moves, f"{base}/in", [arrive[:third], arrive[third : 2 * third] + arrive[:7], arrive[2 * third :]])
    stateful.run(stateful.replayed(state_queries.files_of(moves, f"{base}/in")), f"{base}/state", f"{base}/out")
    changes = spark.read.parquet(f"{base}/out")
    assert tree_of(stateful.latest(changes)) == tree_of(tree.fold(moves)) != []
    # what is told twice in a row would not be a change
    seen = {}
    for r in changes.orderBy("vault", "version").collect():
        place = (r.parent, r.name, r.is_dir)
        assert seen.get((r.vault, r.child), (None, None, None)) != place
        seen[r.vault, r.child] = place


def test_a_settled_log_is_forgotten(spark, base):
    moves = spark.createDataFrame([("v", 1, "a", "d", "root", "n", True)], MOVE)
    first = [("v", c, "a", f"c{c}", "root", f"n{c}", True) for c in (10, 300, 301, 900)]
    settle = [("v", 301, None, None, None, None, None)]
    late = [("v", 299, "a", "c10", "trash", "late", True), ("v", 302, "a", "c10", "c300", "moved", True)]
    lay(moves, f"{base}/in", [first, settle, late])
    stateful.run(stateful.replayed(state_queries.files_of(moves, f"{base}/in")), f"{base}/state", f"{base}/out")
    assert ("v", "c10", "c300", "moved", True) in tree_of(stateful.latest(spark.read.parquet(f"{base}/out")))
    log = stateful.state_rows(spark, f"{base}/state", "log").select(F.explode("user_map_value.records.counter").alias("c"))
    assert sorted(r.c for r in log.collect()) == [302, 900]


def test_operations_wait_for_all_their_causes(spark, base):
    every = state_queries.note_ops(spark, SF).drop("n").cache()
    causes = stateful.text_causes(every)
    held = causes.collect()
    random.Random(1).shuffle(held)
    third = len(held) // 3
    lay(causes, f"{base}/in", [held[:third], held[third : 2 * third] + held[:20], held[2 * third :]])
    stateful.run(stateful.causal(state_queries.files_of(causes, f"{base}/in")), f"{base}/state", f"{base}/out")
    released = spark.read.parquet(f"{base}/out")
    rows = released.collect()
    assert sorted((r.object, r.counter, r.replica) for r in rows) == sorted((r.object, r.counter, r.replica) for r in held)
    when = {(r.object, r.counter, r.replica): r.released for r in rows}
    brings = {}
    for r in held:
        for k in range(r.gives):
            brings[r.object, r.counter + k, r.replica] = when[r.object, r.counter, r.replica]
    for r in held:
        assert all(brings[r.object, r.needs + k, r.needs_replica] < when[r.object, r.counter, r.replica] for k in range(r.needs_n))
    assert stateful.still_waiting(spark, f"{base}/state").count() == 0
    texts = lambda ops: sorted(tuple(r) for r in text_crdt.fold(ops).collect())
    assert texts(stateful.text_ops(released)) == texts(every)


def test_an_operation_waits_for_several_writers_and_a_restart(spark, base):
    schema = "object string, counter long, replica string, gives long, needs long, needs_replica string, needs_n long, payload string"
    rows = spark.createDataFrame([("o", 50, "c", 0, 10, "a", 4, "delete")], schema)
    flow = lambda: stateful.run(stateful.causal(state_queries.files_of(rows, f"{base}/in")), f"{base}/state", f"{base}/out")
    lay(rows, f"{base}/in", [[("o", 50, "c", 0, 10, "a", 4, "delete")], [("o", 12, "a", 2, 0, "", 0, "second")]])
    flow()
    left = stateful.still_waiting(spark, f"{base}/state").collect()
    assert [(r.counter, r.replica, r.needs, r.needs_n) for r in left] == [(50, "c", 10, 4)]
    lay(rows, f"{base}/in", [[("o", 10, "a", 2, 7, "b", 1, "first"), ("o", 50, "c", 0, 10, "a", 4, "delete")], [("o", 7, "b", 1, 0, "", 0, "cause")], [("o", 7, "b", 1, 0, "", 0, "cause")]])
    flow()
    got = sorted((r.released, r.payload) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [(1, "second"), (2, "cause"), (3, "first"), (4, "delete")]
    assert stateful.still_waiting(spark, f"{base}/state").count() == 0


def test_a_log_shrinks_once_all_readers_have_reported(spark, base):
    ops = spark.createDataFrame([("x", "r", 1)], "object string, replica string, counter long")
    reports = spark.createDataFrame([("p", "r", 1)], "reader string, replica string, counter long")
    given = [("x", "r", c) for c in (1, 200, 300, 700)] + [("y", "r", 300)]
    lay(ops, f"{base}/ops", [given])
    lay(reports, f"{base}/reports", [[("p", "r", 650)]])
    flow = lambda: stateful.run(stateful.shrinking(state_queries.files_of(ops, f"{base}/ops"), state_queries.files_of(reports, f"{base}/reports"), ["p", "q"]), f"{base}/state", f"{base}/out")
    flow()
    assert stateful.kept_log(spark, f"{base}/state").count() == 5  # q is silent
    lay(reports, f"{base}/reports", [[("q", "r", 300), ("p", "r", 2)]])
    flow()
    assert [tuple(r) for r in stateful.kept_log(spark, f"{base}/state").collect()] == [("x", "r", 700)]
    lay(ops, f"{base}/ops", [[*given, ("z", "r", 299), ("z", "r", 301)]])
    flow()
    emitted = sorted((r.counter, r.object) for r in spark.read.parquet(f"{base}/out").collect())
    assert emitted == [(1, "x"), (200, "x"), (300, "x"), (300, "y"), (301, "z"), (700, "x")]


@pytest.mark.parametrize("first", ["ops", "came"])
def test_wanted_operations_whichever_stream_is_ahead(spark, base, first):
    """One stream is there whole before the other begins: same result, and nothing is held at the end."""
    streams = dict(zip(("ops", "came"), state_queries.wanted_streams(spark, SF)))
    flow = lambda: stateful.run(stateful.wanted(*[state_queries.files_of(streams[n], f"{base}/{n}", 8) for n in ("ops", "came")], state_queries.HORIZON), f"{base}/state", f"{base}/out", processors=False)
    for rows, name in ((r, n) for n, r in streams.items()):
        rows.limit(0).write.parquet(f"{base}/{name}")
    for name in (first, ({"ops", "came"} - {first}).pop()):
        state_queries.by_counter(streams[name], f"{base}/{name}")
        if name != first:  # after a restart a stream's time is known again once something comes
            state_queries.close(streams[first], f"{base}/{first}", 200)
        query = flow()
    got = spark.read.parquet(f"{base}/out").where("segment IS NOT NULL")
    come = streams["came"].select(F.col("segment").alias("s"), F.col("counter").alias("c")).distinct()
    want = streams["ops"].join(come, (F.col("segment") == F.col("s")) & (F.abs(F.col("counter") - F.col("c")) <= state_queries.HORIZON), "left").select(*streams["ops"].columns, F.col("s").isNotNull().alias("here"))
    rows = lambda d: sorted(tuple(r) for r in d.select("counter", "replica", "kind", "segment", "here").collect())
    assert rows(got) == rows(want)
    held = query.lastProgress["stateOperators"] if hasattr(query.lastProgress, "__getitem__") else query.lastProgress.stateOperators
    assert sum(o["numRowsTotal"] if isinstance(o, dict) else o.numRowsTotal for o in held) < 60


def test_a_log_costs_by_its_records_and_not_by_how_far_apart_they_are(spark, base):
    moves = spark.createDataFrame([("v", 1000 * i, "a", f"c{i % 9}", "root", f"n{i}", True) for i in range(1, 41)], MOVE)
    lay(moves, f"{base}/in", [moves.collect()[20:], moves.collect()[:20]])
    stateful.run(stateful.replayed(state_queries.files_of(moves, f"{base}/in")), f"{base}/state", f"{base}/out")
    assert stateful.state_rows(spark, f"{base}/state", "log").count() == 1
    ops = spark.createDataFrame([("x", f"r{i % 3}", 1000 * i) for i in range(1, 61)], "object string, replica string, counter long")
    reports = spark.createDataFrame([("p", "r1", 10000)], "reader string, replica string, counter long")
    lay(ops, f"{base}/ops", [ops.collect()[30:], ops.collect()[:30]])
    lay(reports, f"{base}/reports", [reports.collect()])
    stateful.run(stateful.shrinking(state_queries.files_of(ops, f"{base}/ops"), state_queries.files_of(reports, f"{base}/reports"), ["p"]), f"{base}/state2", f"{base}/out2")
    assert stateful.state_rows(spark, f"{base}/state2", "log").count() == 3
    assert spark.read.parquet(f"{base}/out2").count() + 4 >= 60


def test_chains_of_one_group_do_not_mix(spark, base, monkeypatch):
    from marginalia.streaming import flows

    monkeypatch.setattr(flows, "bucket", lambda *_: F.lit(0))
    rows = [(o, str(r), c, c - 1) for o in "ab" for r in range(4) for c in range(1, 9) if (r, c) != (2, 5)]
    ops = spark.createDataFrame(rows, "object string, replica string, counter long, prev long")
    random.Random(4).shuffle(rows)
    lay(ops, f"{base}/in", [rows[:30], rows[30:]])
    stream = flows.gap_checked(state_queries.files_of(ops, f"{base}/in"))
    stateful.run(stream, f"{base}/state", f"{base}/out", processors=False)
    got = sorted((r.object, r.replica, r.counter) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == sorted((o, r, c) for o, r, c, _ in rows if r != "2" or c < 5)


def test_the_manifest_is_dealt_to_more_parts_as_the_index_grows(spark, monkeypatch):
    from marginalia.plans import log_queries

    monkeypatch.setattr(log_queries, "PART_ROWS", 200)
    many = log_queries.parts(spark, SF)
    assert many > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert log_queries.state(spark, SF).rdd.getNumPartitions() == many


def test_a_range_of_many_files_comes_whole(spark, monkeypatch):
    """However many files hold a range of counters, none of its rows is late."""
    monkeypatch.setattr(state_queries, "RANGE", 1000, raising=False)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        got = state_queries.st_wanted_memory(spark, SF).groupBy("here").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    ops, came = state_queries.wanted_streams(spark, SF)
    come = came.select(F.col("segment").alias("s"), F.col("counter").alias("c")).distinct()
    here = ops.join(come, (F.col("segment") == F.col("s")) & (F.abs(F.col("counter") - F.col("c")) <= state_queries.HORIZON), "left_semi").count()
    assert {r["here"]: r["count"] for r in got} == {True: here, False: ops.count() - here}


def test_the_manifest_of_a_stream_is_not_held_as_state(spark):
    root = shared_dir(spark).removeprefix("file:")
    stores = lambda: {d for d in os.listdir(root) if os.path.isdir(f"{root}/{d}/state/state")}
    had = stores()
    got = stream_queries.st_manifest_fold(spark, SF)
    want = flows.manifest_totals(log_queries.manifest_ops(spark, SF)).select("segment", F.coalesce("count", F.lit(0)).alias("count"), "dead", "retired")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert stores() == had
