"""Records as bytes, generated edits and moves, and the pieces they are made of."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import records
from marginalia.operators import reading_order, segments, text_crdt, tree
from marginalia.session import numbered
from marginalia.sources import sinks

FIELDS = [("long", "n"), ("string", "t"), ("long", "m"), ("string", "u")]


def test_records_come_back(spark):
    rows = [(0, "", -1, "é"), (1 << 40, "a" * 300, 7, "\x00"), (-(1 << 62), "日本", 0, "")]
    df = spark.createDataFrame(rows, "n long, t string, m long, u string")
    raw = records.pack([(k, F.col(c)) for k, c in FIELDS])
    back = df.select(records.unpack(raw, FIELDS).alias("r")).select("r.*")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_spoiled_records_are_refused(spark):
    df = spark.createDataFrame([(5, "abc", 6, "xyz"), (5, None, 6, "xyz")], "n long, t string, m long, u string")
    raw = records.pack([(k, F.col(c)) for k, c in FIELDS])
    spoiled = [
        F.concat(raw, F.lit(b"x")), F.substring(raw, F.lit(1), F.octet_length(raw) - 1), F.lit(b""), F.lit(b"\xff" * 40),
        F.concat(F.substring(raw, F.lit(1), F.octet_length(raw) - 3), F.lit(b"\xff\xfe\xfd")),
    ]
    got = df.select(*[records.unpack(s, FIELDS).isNull().alias(f"c{i}") for i, s in enumerate(spoiled)])
    assert all(all(r) for r in got.collect())


def test_marks(spark):
    df = spark.createDataFrame([({3: 9, 1: 4},), ({},), ({1: 0},), (None,)], "m map<long,long>")
    raw = df.select(records.pack_marks(F.col("m")).alias("raw"), "m")
    got = [(r["m"], None if r["p"] is None else [tuple(e) for e in r["p"]]) for r in raw.select("m", records.unpack_marks(F.col("raw")).alias("p")).collect()]
    assert got == [({3: 9, 1: 4}, [(1, 4), (3, 9)]), ({}, []), ({1: 0}, None), (None, None)]
    pair = records.number(F.lit(2)), records.number(F.lit(5))
    twice = spark.range(1).select(records.unpack_marks(F.concat(*pair, *pair)).alias("p"))
    assert twice.first()["p"] is None


@given(st.binary(max_size=4), st.binary(max_size=6))
@settings(max_examples=300, deadline=None)
def test_a_prefix_is_a_range(prefix, key):
    end = records.prefix_end(prefix)
    assert key.startswith(prefix) == (key >= prefix and (end is None or key < end))


def test_sealing(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("", "x"), (None, "x")], "t string, about string")
    key = b"k" * 16
    got = df.select("t", records.seal(F.col("t"), key, F.col("about")).alias("s"), "about")
    rows = got.select("t", "s", records.unseal(F.col("s"), key, F.col("about")).alias("back"), records.unseal(F.col("s"), b"j" * 16, F.col("about")).alias("other")).collect()
    assert [r["back"] for r in rows] == ["a", "a", "", None] and all(r["other"] is None for r in rows)
    assert len({bytes(r["s"]) for r in rows[:3]}) == 3


def ops(spark, rows):
    """Rows are (counter, text, parent, side) for an insert or (counter, target, count) for a delete, of one note."""
    kind = "struct<counter:bigint,replica:string>"
    full = [
        ("d", r[0], "a", "insert", r[2], r[3], [ord(c) for c in r[1]], None, None) if len(r) == 4 else ("d", r[0], "a", "delete", None, None, None, r[1], r[2])
        for r in rows
    ]
    return spark.createDataFrame(full, f"object string, counter long, replica string, kind string, parent {kind}, side string, text array<int>, target {kind}, count int")


NOTE = [(1, "hello", None, "right"), (10, (2, "a"), 2)]  # leaves h, l, o: 1, 4, 5


@pytest.mark.parametrize("at", [1, 2, 3])
def test_a_typed_text_lands_where_it_was_typed(spark, at):
    base = ops(spark, NOTE)
    place = text_crdt.inserts_at(base, spark.createDataFrame([("d", at)], "object string, at int")).collect()
    assert len(place) == 1
    typed = (20, "XY", (place[0]["parent_counter"], place[0]["parent_replica"]), place[0]["side"])
    text = text_crdt.fold(ops(spark, [*NOTE, typed])).first()["text"]
    assert text == "hlo"[:at] + "XY" + "hlo"[at:]


def test_deletes_are_coalesced_runs(spark):
    base = ops(spark, NOTE)
    wanted = spark.createDataFrame([("d", 0, 2)], "object string, at int, length int")
    runs = sorted((r["counter"], r["count"]) for r in text_crdt.deletes_at(base, wanted).collect())
    assert runs == [(1, 1), (4, 1)]
    whole = ops(spark, [*NOTE, *[(30 + i, (c, "a"), n) for i, (c, n) in enumerate(runs)]])
    assert text_crdt.fold(whole).first()["text"] == "o"


def test_malformed_operations_are_left_out(spark):
    rows = [*NOTE, (0, "x", None, "right"), (5, "", None, "right"), (6, "x", (1, None), "right"), (7, (1, "a"), 0), (8, None, 1)]
    assert sorted(r["counter"] for r in text_crdt.well_formed(ops(spark, rows)).collect()) == [1, 10]


def test_changes_become_moves(spark):
    events = spark.createDataFrame(
        [("v", "created", "b/n.md", None), ("v", "deleted", "a/o.md", "i1"), ("v", "modified", "a/p.md", "i2"), ("v", "moved", "q.md", "i3")],
        "vault string, kind string, path string, id string",
    )
    got = [tuple(r) for r in tree.moves_for(events, 7, "me").orderBy("counter").select("counter", "child", "parent", "name").collect()]
    assert got == [(8, "i1", "trash", "o.md"), (9, "b/n.md", "b", "n.md"), (10, "i3", "root", "q.md")]


def test_detached_nodes(spark):
    nodes = spark.createDataFrame(
        [("v", "a", "root", "a", True), ("v", "b", "c", "b", True), ("v", "c", "b", "c", True), ("v", "d", "gone", "d", False), ("v", "e", "trash", "e", False)],
        "vault string, child string, parent string, name string, is_dir boolean",
    )
    assert sorted(r["child"] for r in tree.detached(nodes).collect()) == ["b", "c", "d"]


def test_cursors_only_advance(spark, tmp_path):
    path = str(tmp_path / "cursors")
    for n in (5, 9, 3):
        sinks.advance(spark.createDataFrame([("a", n)], "object string, counter long"), path, ["object"])
    assert [tuple(r) for r in sinks.cursors(spark, path, ["object"]).collect()] == [("a", 9)]


def test_loopback(spark):
    urls = {"http://127.1.2.3/": True, "http://u@localhost:1/": True, "http://[::1]/": True, "http://localhost.example/": False, "http://10.0.0.1/?127.0.0.1": False, "": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["l"] for r in df.select("u", records.is_loopback(F.col("u")).alias("l")).collect()} == urls


OPS = "object string, counter long, replica string, kind string, parent struct<counter:bigint,replica:string>, side string, text array<int>, target struct<counter:bigint,replica:string>, count int"


def typed(seed, n_ops, name):
    """Several writers typing after, before and into each other's text; some of it is deleted, some hangs on nothing."""
    rng, ids, ops, clock = random.Random(seed), [], [], 1
    for i in range(n_ops):
        writer, size = rng.choice("abc"), rng.randint(1, 9)
        parent = None if not ids or rng.random() < 0.05 else ids[-1] if rng.random() < 0.6 else rng.choice(ids)
        if i % 50 == 49:
            parent = (10**9 + i, "nobody")
        ops.append((name, clock, writer, "insert", parent, rng.choice(["left", "right", "right"]), [97 + rng.randrange(26) for _ in range(size)], None, None))
        ids += [(clock + k, writer) for k in range(size)]
        clock += size
        if rng.random() < 0.1:
            ops.append((name, clock, writer, "delete", None, None, None, rng.choice(ids), rng.randint(1, 3)))
            clock += 3
    return ops


def test_long_documents_are_read_as_short_ones(spark):
    """Ranking by joins gives every character the place that the walk gives it."""
    one = [("one", 7, "a", "insert", None, "left", [97], None, None)]
    lost = [("lost", 7, "a", "insert", (3, "b"), "left", [97, 98], None, None)]
    chain = [("deep", k, "a", "insert", (k - 1, "a") if k > 1 else None, "left", [97], None, None) for k in range(1, 400)]
    circle = [("circle", 5, "a", "insert", (9, "b"), "right", [97], None, None), ("circle", 9, "b", "insert", (5, "a"), "left", [98], None, None), ("circle", 20, "c", "insert", None, "left", [99], None, None)]
    ops = spark.createDataFrame(typed(1, 400, "x") + typed(2, 300, "y") * 2 + one + lost + chain + circle, OPS)
    rows = lambda large: sorted(tuple(r) for r in text_crdt.ordered(ops, large).collect())
    assert rows(0) == rows(10**9) == rows(1500) != []


def test_lists_are_ranked_by_doubling(spark):
    """Three lists, one that ends nowhere and one that goes round."""
    lists = [(0, 1, 5), (1, 2, 0), (2, None, 7), (10, None, 1), (20, 21, 1), (21, 99, 1), (30, 31, 1), (31, 30, 1)] + [(k, k + 1 if k < 1400 else None, 1) for k in range(400, 1401)]
    got = {r.id: r.rest for r in reading_order.ranked(spark.createDataFrame(lists, "id long, next long, weight long")).collect()}
    assert got == {0: 12, 1: 7, 2: 7, 10: 1} | {k: 1401 - k for k in range(400, 1401)}


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.text("ab", max_size=9), st.text("ab", max_size=9))
def test_common_ends_by_halves(a, b, x, y):
    old, new = a + x + b, a + y + b
    start, deleted, inserted = text_crdt.replaced_middle(old, new)
    assert old[:start] + inserted + old[start + deleted :] == new
    assert start >= len(a) or old[:start] == new[:start]
    kept = len(old) - deleted
    naive = 0
    while naive < min(len(old), len(new)) and old[naive] == new[naive]:
        naive += 1
    assert start == naive and kept >= len(a) if len(old) >= len(a) + len(b) else True


def test_rows_are_numbered_within_groups_of_any_size(spark):
    rows = [("big", i % 97, i) for i in range(3000)] + [(f"g{i % 40}", i, i) for i in range(200)] + [(None, i, i) for i in range(5)]
    random.Random(3).shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "g string, o int, n int").repartition(7), ["o", "n"], within=("g",)).collect()
    want = {}
    for g, o, n in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[g, o, n] = want[g, "last"] = want.get((g, "last"), 0) + 1
    assert all(r.place == want[r.g, r.o, r.n] for r in got) and len(got) == len(rows)
    upto = {r.n: r.before for r in numbered(spark.createDataFrame(rows, "g string, o int, n int").where("g = 'big'"), ["n"], "before", F.col("o").cast("long"), within=("g",)).collect()}
    assert all(upto[n] == sum(i % 97 for i in range(n)) for n in (0, 1, 500, 2999))


def test_paths_of_a_deep_chain_and_of_circles(spark):
    """A thousand levels in a few rounds; what leads nowhere or round is left out."""
    chain = [("v", f"c{i}", f"c{i - 1}" if i else "root", f"n{i}", True) for i in range(1000)]
    rows = chain + [("v", "a", "b", "x", True), ("v", "b", "a", "y", True), ("v", "lost", "nobody", "z", False), ("v", "t", "trash", "t", False), ("w", "c0", "root", "other", False)]
    got = {(r.vault, r.child): r.path for r in tree.paths(spark.createDataFrame(rows, "vault string, child string, parent string, name string, is_dir boolean")).collect()}
    assert len(got) == 1001 and got["w", "c0"] == "other"
    assert got["v", "c999"] == "/".join(f"n{i}" for i in range(1000))


def test_a_changed_vector_is_not_opened(spark):
    entries = spark.createDataFrame([("s", i, "o", [float(i), 1.0], i * 10, "h") for i in range(4)] + [("t", 0, "p", [1.0, 2.0], 0, None)], "segment string, slot int, object string, vector array<double>, start int, heading string")
    sealed = segments.digests(entries).withColumn("model", F.lit("m")).withColumn("dimension", F.lit(2))
    look = lambda rows: {r.segment: r.refused for r in segments.opened(sealed, rows, "m", 2).collect()}
    assert look(entries) == look(entries.repartition(3)) == {"s": None, "t": None}
    for column, value in (("vector", F.array(F.lit(1.0), F.lit(2.5))), ("start", F.lit(1)), ("heading", F.lit("x"))):
        changed = entries.withColumn(column, F.when(F.col("segment") == "t", value).otherwise(F.col(column)))
        assert look(changed) == {"s": None, "t": "damaged"}


def test_paths_round_a_circle_stop_with_the_last_arrival(spark, monkeypatch):
    """Below a circle nothing arrives, so that paths there must not double as often as the table has bits."""
    rows = [("v", "a", "b"), ("v", "b", "a"), ("v", "x0", "root"), ("w", "r", "trash")] + [("v", f"n{i}", "a") for i in range(600)] + [("v", f"x{i}", f"x{i - 1}") for i in range(1, 6)]
    nodes = spark.createDataFrame([(v, c, p, c, False) for v, c, p in rows], "vault string, child string, parent string, name string, is_dir boolean")
    real, longest = tree.cut, []

    def watched(rows):
        out = real(rows)
        longest.append(out.agg(F.max(F.length("path"))).first()[0])
        return out

    monkeypatch.setattr(tree, "cut", watched)
    assert {(r.vault, r.child) for r in tree.detached(nodes).collect()} == {("v", "a"), ("v", "b")} | {("v", f"n{i}") for i in range(600)}
    assert max(r.path.count("/") for r in tree.paths(nodes).collect()) == 5
    assert max(longest) < 100


def test_compaction_of_long_deleted_lines_and_circles(spark, monkeypatch):
    """What dropping leaves again and again leaves, in rounds that don't grow with the length of a line."""
    rng = random.Random(8)
    rows = [("a", i, "r", i - 1 if i > 1 else None, "r" if i > 1 else None, i > 3) for i in range(1, 120)]
    rows += [("b", i, "r", rng.randrange(1, i) if i > 1 else None, "r" if i > 1 else None, rng.random() < 0.8) for i in range(1, 150)]
    rows += [("c", i, "r", i % 3 + 1, "r", True) for i in (1, 2, 3)] + [("c", 4, "r", 1, "r", True), ("c", 5, "r", 4, "r", True), ("c", 6, "s", 1, "r", True), ("c", 7, "r", 6, "s", True)]
    chars = spark.createDataFrame(rows, "object string, counter long, replica string, parent_counter long, parent_replica string, deleted boolean")
    left, n = {r[:3]: r for r in rows}, 0
    while n != len(left):
        n = len(left)
        parents = {(r[0], r[3], r[4]) for r in left.values()}
        left = {k: r for k, r in left.items() if not r[5] or k in parents or r[2] != "r" or r[1] > 140}
    real, cuts = text_crdt.cut, []
    monkeypatch.setattr(text_crdt, "cut", lambda d: cuts.append(1) or real(d))
    got = text_crdt.compacted(chars, spark.createDataFrame([("r", 140), ("r", 9)], "replica string, counter long"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, left.values()))
    assert len(cuts) < 20


def read_by_hand(chars):
    """Characters of one document as a plain walk gives them."""
    below = {}
    for c in sorted(chars):
        below.setdefault((c[2], c[3], c[4]), []).append(c)

    def walk(at):
        for c in below.get((*at, "left"), []):
            yield from around(c)

    def around(c):
        yield from walk((c[0], c[1]))
        yield c
        for d in below.get((c[0], c[1], "right"), []):
            yield from around(d)

    return [*walk((0, "")), *(x for c in below.get((0, "", "right"), []) for x in around(c))]


def test_documents_are_dealt_once_and_read_across_batches(spark):
    """Random trees of several writers, with repeats, missing parents and deletes; a batch ends inside most documents."""
    rng, ops, want = random.Random(11), [], {}
    for name in [f"n{k}" for k in range(12)]:
        chars, counter, dead = [], 0, set()
        for _ in range(rng.randint(1, 40)):
            writer, size = rng.choice("abc"), rng.randint(1, 5)
            counter += rng.randint(1, 4)
            parent = rng.choice([(0, ""), (10**6, "a"), *[c[:2] for c in chars] * 3])
            side = rng.choice(["left", "right", "right"])
            run = [(counter + i, writer, *(parent if i == 0 else (counter + i - 1, writer)), side if i == 0 else "right", rng.randint(97, 122)) for i in range(size)]
            ops += [(name, counter, writer, "insert", parent if parent[0] else None, side, [c[5] for c in run], None, None)] * rng.randint(1, 2)
            if rng.random() < 0.3:
                dead |= {(counter + i, writer) for i in range(2)}
                ops += [(name, counter + 50, writer, "delete", None, None, None, (counter, writer), 2)] * 2
            chars += run
            counter += size
        read = read_by_hand(chars)
        want[name] = ([(c[0], c[1]) for c in read], "".join(chr(c[5]) for c in read if c[:2] not in dead))
    rng.shuffle(ops)
    ids = "struct<counter:long,replica:string>"
    table = spark.createDataFrame(ops, f"object string, counter long, replica string, kind string, parent {ids}, side string, text array<int>, target {ids}, count int")
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        folded = text_crdt.fold(table)
        assert {r.object: r.text for r in folded.collect()} == {k: v[1] for k, v in want.items()}
        for large in (10**6, 30):
            got = {}
            for r in text_crdt.ordered(table, large).orderBy("object", "place").collect():
                got.setdefault(r.object, []).append((r.counter, r.replica))
            assert got == {k: v[0] for k, v in want.items() if v[0]}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    assert text_crdt.fold(table)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
