"""Keyed tables, the outbox and the counts of a fetch: what is there after repeats, conflicts, crashes and restarts."""

import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marginalia.session import shared_dir
from marginalia.sources import keyed
from marginalia.sources.outbox import Outbox
from marginalia.streaming import fetching


@pytest.fixture
def base(spark):
    return f"{shared_dir(spark).rstrip('/')}/test-{uuid.uuid4().hex}"


def table(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def of(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, n long, v string")


def test_the_newest_row_of_a_key_stays(spark, base):
    put = lambda n, *rows: keyed.merge(of(spark, *rows), base, ["k"], n, newest=["n"], buckets=4)
    put(0, ("a", 5, "x"), ("b", 1, "y"), (None, 1, "null"), ("a", 5, "x"))
    put(1, ("a", 3, "older"), ("b", 2, "newer"), ("c", 1, "one"), ("c", 1, "two"))
    put(1, ("a", 99, "a batch that comes again does nothing"))
    put(2)
    put(3, (None, 2, "later"), ("a", None, "no order"))
    assert table(keyed.read(spark, base)) == table(of(spark, ("a", 5, "x"), ("b", 2, "newer"), ("c", 1, "two"), (None, 2, "later")))
    assert table(keyed.read(spark, base, {"k": "b"}, 4)) == [("b", 2, "newer")]
    assert table(keyed.read(spark, base, {"k": None}, 4)) == [(None, 2, "later")]


def test_a_key_with_other_bytes_is_refused(spark, base):
    put = lambda n, *rows: table(keyed.merge(of(spark, *rows), base, ["k", "n"], n, buckets=4))
    assert put(0, ("a", 1, "x"), ("b", 1, None)) == []
    assert put(1, ("a", 1, "x"), ("a", 1, "other"), ("b", 1, None), ("a", 2, "new"), ("c", 1, "p"), ("c", 1, "q")) == [("a", 1, "other"), ("c", 1, "p")]
    assert put(2, ("b", 1, "other")) == [("b", 1, "other")]
    assert table(keyed.read(spark, base)) == table(of(spark, ("a", 1, "x"), ("a", 2, "new"), ("b", 1, None), ("c", 1, "q")))


def test_a_merge_reads_and_writes_its_own_buckets_alone(spark, base):
    rows = spark.range(400).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n"), F.lit("v").alias("v"))
    keyed.merge(rows, base, ["k"], 0, newest=["n"], buckets=16)
    before = keyed._current(spark, base)
    keyed.merge(of(spark, ("7", 1000, "w")), base, ["k"], 1, newest=["n"], buckets=16)
    after = keyed._current(spark, base)
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    one = keyed.read(spark, base, {"k": "7"}, 16)
    assert {f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()} == {str(b) for b in before if before[b] != after[b]}
    assert table(one) == [("7", 1000, "w")]
    assert keyed.read(spark, base).count() == 400
    assert keyed.tidy(spark, base) == 1 and keyed.tidy(spark, base) == 0
    assert keyed.read(spark, base).count() == 400


def test_a_merge_that_breaks_off_leaves_nothing_that_counts(spark, base, monkeypatch):
    keyed.merge(of(spark, ("a", 1, "x")), base, ["k"], 0, buckets=2)
    noted = keyed.NOTES
    monkeypatch.setattr(keyed, "NOTES", "broken")
    with pytest.raises(Exception):
        keyed.merge(of(spark, ("a", 2, "y"), ("b", 2, "y")), base, ["k"], 1, newest=["n"], buckets=2)
    monkeypatch.setattr(keyed, "NOTES", noted)
    assert table(keyed.read(spark, base)) == [("a", 1, "x")]
    keyed.merge(of(spark, ("b", 2, "y")), base, ["k"], 1, buckets=2)
    assert table(keyed.read(spark, base)) == [("a", 1, "x"), ("b", 2, "y")]


def test_nothing_to_read(spark, base):
    with pytest.raises(AnalysisException):
        keyed.read(spark, base)


@pytest.mark.parametrize("stops_at", ["claimed", "delivered", None])
def test_a_drain_that_stops_delivers_each_row_once(spark, base, stops_at):
    rows = [(f"k{i}", i, "v") for i in range(10)]
    box = Outbox(spark, f"{base}/box", ["k"], page=4)
    box.put(of(spark, *rows, rows[3]))
    calls = []

    def deliver(page, n):
        calls.append(n)
        if n == 2 and calls.count(2) == 1 and stops_at == "claimed":
            raise RuntimeError("before it left")
        keyed.merge(page, f"{base}/log", ["k"], n, buckets=2)
        if n == 2 and calls.count(2) == 1 and stops_at == "delivered":
            raise RuntimeError("after it left")

    if stops_at:
        with pytest.raises(RuntimeError):
            box.drain(deliver)
        assert box.pending().count() == 6
        box.put(of(spark, ("k10", 10, "v")))
        rows.append(("k10", 10, "v"))
        box = Outbox(spark, f"{base}/box", ["k"], page=4)
    box.drain(deliver)
    assert calls == ([1, 2, 2, 3] if stops_at else [1, 2, 3])
    assert table(keyed.read(spark, f"{base}/log")) == table(of(spark, *rows))
    assert box.pending().count() == 0 and box.drain(deliver) == 0


def test_a_fetch_counts_itself_over_batches_and_a_restart(spark, base):
    schema = "object string, replica string, counter long"
    lay = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run = lambda: [(s.object, s.fetched, s.applied, s.repeats, s.cursor_after) for s in fetching.fetched(stream(), ["p", "q", "r"], f"{base}/state", f"{base}/out")]
    lay(("p", "a", 1), ("p", "a", 2), ("p", "a", 2), ("x", "a", 1))
    lay(("p", "a", 2), ("q", "b", 7))
    assert run() == [("p", 4, 2, 2, 2), ("q", 1, 1, 0, 7), ("r", 0, 0, 0, 0)]
    lay(("p", "a", 1), ("p", "a", 9))
    assert run() == [("p", 2, 1, 1, 9), ("q", 0, 0, 0, 0), ("r", 0, 0, 0, 0)]
    assert spark.read.schema(schema).parquet(f"{base}/out").count() == 5
