"""Change detection, trees, text documents, passages, sources, sinks and streams."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as text_functions
from marginalia.operators import chunker, snapshot, text_crdt, tree
from marginalia.session import cut as cut_lineage, stored
from marginalia.sources import hints, notes, sinks
from marginalia.streaming import flows

SNAPSHOT = "path string, id string, dev int, ino long, nlink int, hash string"


def events(spark, before, after, renamed=()):
    """``before`` and ``after``: path -> (inode, hash[, links])."""
    table = lambda d, known: spark.createDataFrame(
        [(p, f"id-{p}" if known else None, 1, v[0], (v + (1,))[2], v[1]) for p, v in d.items()], SNAPSHOT
    )
    flags = spark.createDataFrame([(p, True) for p in renamed], "path string, renamed boolean")
    return [(r.kind, r.path, r.old_path) for r in snapshot.in_order(snapshot.reconcile(table(before, True), table(after, False), flags)).collect()]


CASES = [
    ({}, {"a": (1, "x")}, (), [("created", "a", None)]),
    ({"a": (1, "x")}, {"a": (1, "y")}, (), [("modified", "a", None)]),
    ({"a": (1, "x")}, {"a": (1, "x")}, (), []),
    ({"a": (1, "x")}, {}, (), [("deleted", "a", None)]),
    ({"a": (1, "x")}, {"a": (2, "y")}, (), [("modified", "a", None)]),
    ({"a": (1, "x")}, {"a": (2, "x")}, (), []),
    ({"a": (1, "x")}, {"b": (1, "x")}, ("b",), [("moved", "b", "a")]),
    ({"a": (1, "x")}, {"b": (1, "x")}, (), [("deleted", "a", None), ("created", "b", None)]),
    ({"a": (1, "x")}, {"b": (1, "y")}, ("a",), [("moved", "b", "a")]),
    ({"a": (1, "x", 2), "c": (1, "x", 2)}, {"b": (1, "x", 2), "c": (1, "x", 2)}, ("b",), [("deleted", "a", None), ("created", "b", None)]),
    ({"a": (1, "x"), "b": (2, "y")}, {"a": (2, "y"), "b": (1, "x")}, ("a", "b"), [("moved", "a", "b"), ("moved", "b", "a")]),
    ({"a": (1, "x"), "b": (2, "y")}, {"a": (2, "y")}, ("a",), [("deleted", "a", None), ("moved", "a", "b")]),
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_histories(spark, case):
    before, after, renamed, want = case
    assert sorted(events(spark, before, after, renamed), key=str) == sorted(want, key=str)


def test_which_files_are_notes(spark):
    from pyspark.sql import functions as F

    names = {"a.md": True, "x/B.MD": True, ".a.md": False, "#a.md": False, "a.txt": False, ".git/a.md": True, "_a.md": True, "md": False}
    got = spark.createDataFrame([(n,) for n in names], "path string").select("path", snapshot.is_vault_file(F.col("path")).alias("y")).collect()
    assert {r.path: r.y for r in got} == names


# ------------------------------------------------------------------ trees

MOVES = "vault string, counter long, replica string, child string, parent string, name string, is_dir boolean"


def replayed(ops):
    """Moves in order, the ancestors of the new parent checked each time."""
    place = {}
    for counter, replica, child, parent, name in sorted(ops):
        up, seen = parent, set()
        while up in place and up not in seen:
            seen.add(up)
            up = place[up][0]
        if child != parent and child not in seen | {up}:
            place[child] = (parent, name)
    return place


@pytest.mark.parametrize("seed", range(4))
def test_tree_fold_in_any_order(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(8)]
    ops = [(i + 1, rng.choice("ab"), rng.choice(ids), rng.choice([*ids, "root", "trash"]), f"f{i}") for i in range(60)]
    rows = [("v", *o, True) for o in ops]
    rng.shuffle(rows)
    got = {r.child: (r.parent, r.name) for r in tree.fold(spark.createDataFrame(rows + rows[:9], MOVES)).collect()}
    assert got == replayed(ops)


def test_tree_paths_trash_and_detached(spark):
    rows = [("v", 1, "a", "d", "root", "docs", True), ("v", 2, "a", "f", "d", "x.md", False), ("v", 3, "a", "t", "trash", "old", True), ("v", 4, "a", "u", "t", "y.md", False), ("v", 5, "a", "z", "nowhere", "z", False), ("v", 6, "a", "w", "d", "..", False)]
    nodes = tree.fold(spark.createDataFrame(rows, MOVES))
    assert {r.path: r.child for r in tree.listing(nodes).collect()} == {"docs": "d", "docs/x.md": "f"}
    assert {r.child for r in tree.deleted(nodes).collect()} == {"t", "u"}


# ------------------------------------------------------------------ text

TEXT = "object string, counter long, replica string, kind string, parent struct<counter:bigint,replica:string>, side string, text array<int>, target struct<counter:bigint,replica:string>, count int"


def insert(counter, replica, parent, side, text):
    return ("o", counter, replica, "insert", parent, side, [ord(c) for c in text], None, None)


def delete(counter, replica, target, count):
    return ("o", counter, replica, "delete", None, None, None, target, count)


def rendered(spark, ops):
    r = text_crdt.fold(spark.createDataFrame(ops, TEXT)).first()
    return r.text, r.length, r.tombstones


def test_runs_do_not_interleave(spark):
    ops = [insert(1, "a", None, "right", "X"), insert(2, "a", (1, "a"), "right", "aaa"), insert(2, "b", (1, "a"), "right", "bbb"), insert(9, "c", (1, "a"), "left", "<<")]
    for seed in range(3):
        random.Random(seed).shuffle(ops)
        assert rendered(spark, ops + ops[:2]) == ("<<Xaaabbb", 9, 0)


def test_deletes_split_and_compact(spark):
    ops = [insert(1, "a", None, "right", "hello"), delete(10, "b", (2, "a"), 2), delete(11, "c", (3, "a"), 2), delete(11, "c", (3, "a"), 2)]
    assert rendered(spark, ops) == ("ho", 2, 3)
    nodes = text_crdt.nodes(spark.createDataFrame(ops, TEXT))
    left = text_crdt.compacted(nodes, spark.createDataFrame([("a", 3)], "replica string, counter long"))
    assert left.count() == 5  # the deleted ones up to the mark still carry others
    gone = [delete(12, "c", (4, "a"), 2)]
    nodes = text_crdt.nodes(spark.createDataFrame(ops + gone, TEXT))
    left = text_crdt.compacted(nodes, spark.createDataFrame([("a", 99)], "replica string, counter long"))
    assert left.count() == 1


def test_missing_parents_are_reported(spark):
    ops = [insert(5, "b", (4, "a"), "right", "q"), insert(1, "a", None, "right", "z")]
    assert [(r.counter, r.replica) for r in text_crdt.without_parent(spark.createDataFrame(ops, TEXT)).collect()] == [(5, "b")]


@given(st.text("ab", max_size=8), st.text("ab", max_size=8))
def test_the_middle_is_all_that_changes(old, new):
    start, deleted, inserted = text_crdt.replaced_middle(old, new)
    assert old[:start] + inserted + old[start + deleted :] == new and deleted >= 0


# ------------------------------------------------------------------ passages


def cut(text):
    raw = text.encode()
    return [(k, p, raw[s:e].decode()) for s, e, k, p, *_ in chunker.ranges(raw)]


def test_headings_make_sections_and_paths():
    got = cut("# A\n\nfirst\n\n## B ##\nsecond\n\nTitle\n-----\nthird\n")
    assert got == [("prose", "A", "# A\n\nfirst\n\n"), ("prose", "A > B", "## B ##\nsecond\n\n"), ("prose", "A > Title", "Title\n-----\nthird\n")]


def test_front_matter_only_at_the_top():
    got = cut("---\na: 1\n---\ntext\n\n---\nmore\n")
    assert [(k, t) for k, _, t in got] == [("front-matter", "---\na: 1\n---\n"), ("prose", "text\n\n---\nmore\n")]
    assert [k for k, _, _ in cut("---\nnever closed\n")] == ["prose"]


def test_code_is_never_split_and_absorbs_when_it_fits():
    code = "```py\n" + "x = 1\n" * 600 + "```\n"
    got = cut("intro\n\n" + code + "\nafter\n")
    assert [k for k, _, _ in got] == ["prose", "code", "prose"] and got[1][2] == code
    assert [k for k, _, _ in cut("intro\n```\nsmall\n```\n")] == ["prose"]


def test_large_tables_keep_their_header_in_the_text_only():
    table = "| a | b |\n|---|---|\n" + "| value one | value two |\n" * 120
    rows = chunker.ranges(table.encode())
    assert len(rows) > 1 and all(r[2] == "table" and r[4:] == (0, 20) for r in rows)
    assert rows[0][0] == 20 and rows[-1][1] == len(table) and all(a[1] == b[0] for a, b in zip(rows, rows[1:]))


def test_long_lines_are_cut_between_characters():
    text = "é" * 2000
    parts = cut(text)
    assert "".join(p for _, _, p in parts) == text and all(len(p.encode()) <= chunker.MAX for _, _, p in parts)


def test_fences_inside_lists_are_not_cut():
    item = "- step\n  ```sh\n" + "  run --this --that\n" * 40 + "  ```\n"
    for _, _, part in cut(item * 6):
        assert part.count("```") % 2 == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# h", "text of a line", "- item", "1. one", "> quote", "```", "| a |", "|---|", "", "===", "---", "  indented", "é" * 700]), max_size=40))
def test_passages_are_in_order_and_inside(lines):
    raw = "\n".join(lines).encode()
    at = 0
    for start, end, kind, *_ in chunker.ranges(raw):
        assert at <= start < end <= len(raw) and kind in chunker.KINDS
        raw[start:end].decode()
        at = end


def test_passages_table(spark):
    rows = [("a", "# T\n\n- [[x]]\n- [[y]]\n"), ("b", ""), ("c", None), ("d", "tiny"), ("e", "body\r\nmore\r\n")]
    got = {(r.object, r.ordinal): r for r in chunker.chunks(spark.createDataFrame(rows, "object string, text string")).collect()}
    assert set(got) == {("a", 0), ("d", 0), ("e", 0)}
    assert got["a", 0].kind == "link-list" and got["a", 0].heading_path == "T" and got["a", 0].text.startswith("T\n\n# T")
    only = chunker.chunks(spark.createDataFrame([("l", "- [[one]]\n- [[two]]\n")], "object string, text string")).first()
    assert only.kind == "link-list" and only.link_ratio == 8750
    digests = chunker.digests(chunker.chunks(spark.createDataFrame([("x", "# H\nw\n"), ("y", "# K\nv\n")], "object string, text string"))).collect()
    assert len({r.digest for r in digests}) == 1


def test_hashed_vectors(spark):
    v = text_functions.hashed_vector(["alpha", "beta"], 32)
    assert v @ v == pytest.approx(1.0) and text_functions.hashed_vector([], 8)[0] == 1.0
    assert text_functions.model_id("a", "b", "c", "d", 8, True) != text_functions.model_id("ab", "", "c", "d", 8, True)


# ------------------------------------------------------------------ sources and sinks


@pytest.fixture
def vault(tmp_path):
    for path, body in {"a.md": "alpha", "sub/b.md": "beta", "sub/.hidden.md": "no", ".git/c.md": "no", "d.txt": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    return tmp_path


def test_folders_of_notes(spark, vault):
    assert sorted(r.path.split("/")[-1] for r in notes.note_files(spark, str(vault)).collect()) == ["a.md", "b.md"]
    assert sorted(bytes(r.content) for r in notes.note_texts(spark, str(vault)).collect()) == [b"alpha", b"beta"]
    walked = {r.path: r.is_dir for r in notes.walk(spark, str(vault)).collect()}
    assert walked["sub"] and not walked["a.md"] and "sub/.hidden.md" in walked
    os.rename(vault / "a.md", vault / "sub" / "moved.md")
    now = notes.snapshot(spark, str(vault)).collect()
    assert {r.path for r in now} >= {"sub/moved.md", "sub/b.md"} and all(len(r.hash) == 64 for r in now)


def test_questions_and_json(spark, tmp_path):
    (tmp_path / "q.tsv").write_text('# comment\nwhat "is" it?\tthis\nunknown?\tNONE\n')
    assert sorted(map(tuple, notes.questions(spark, str(tmp_path / "q.tsv")).collect())) == [("unknown?", None), ('what "is" it?', "this")]
    assert sinks.json_events(spark.createDataFrame([(1,)], "n int"), "built").first().value == '{"event":"built","n":1}'


def test_appends_and_files_may_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        sinks.append_new(rows, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    texts = spark.createDataFrame([("x/y.md", "hello")], "path string, text string")
    assert [r.written for r in sinks.materialise(texts, str(tmp_path / "out")).collect()] == [True]
    assert [r.written for r in sinks.materialise(texts, str(tmp_path / "out")).collect()] == [False]


# ------------------------------------------------------------------ streams


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_gaps_hold_back_what_follows(spark, tmp_path):
    schema = "object string, replica string, counter long, prev long"
    batches = [[("o", "r", 1, 0), ("o", "r", 5, 3), ("o", "s", 2, 0)], [("o", "r", 3, 1), ("o", "r", 3, 1)], [("o", "r", 9, 7)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = run(spark, flows.gap_checked(stream), "gaps")
    assert sorted((r.replica, r.counter) for r in got) == [("r", 1), ("r", 3), ("r", 5), ("s", 2)]


def test_bursts_are_flushed_when_quiet_or_overdue(spark, tmp_path):
    schema = "vault string, path string, renamed boolean, ms long"
    steady = [("v", f"p{i % 3}", i == 4, 1000 + 30 * i) for i in range(20)]
    later = [("v", "q", False, 60_000), ("v", "z", False, 120_000)]
    for i, b in enumerate([steady, later[:1], later[1:]]):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    hints = stream.selectExpr("vault", "path", "renamed", "timestamp_millis(ms) AS ts")
    got = sorted((r.flushed_at, r.path, r.renamed) for r in run(spark, flows.debounced(hints), "bursts"))
    assert got[:3] == [(1400, "p0", False), (1400, "p1", True), (1400, "p2", False)]
    assert {r[1] for r in got[3:6]} == {"p0", "p1", "p2"} and (60_040, "q", False) in got


def test_running_manifest(spark, tmp_path):
    schema = "counter long, replica string, segment string, kind string, count long, slot int, superseded_by string"
    rows = [(1, "a", "s", "add", 3, None, None), (2, "a", "s", "tombstone", None, 1, None), (2, "a", "s", "tombstone", None, 1, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    r = run(spark, flows.manifest_totals(stream), "manifest", "complete")[0]
    assert (r["count"], r.dead, r.retired) == (3, 1, 0)


def test_reconcile_batches_keep_the_snapshot(spark):
    row = lambda p, i, ino, h: (p, i, 1, ino, 1, h)
    first = spark.createDataFrame([row("a", "A", 1, "x"), row("b", "B", 2, "y")], SNAPSHOT)
    states = [[row("a", None, 1, "z"), row("b", None, 2, "y")], [row("c", None, 1, "z"), row("b", None, 2, "y")]]
    seen = []
    step = flows.reconcile_batches(spark, first, lambda: spark.createDataFrame(states.pop(0), SNAPSHOT), lambda e: seen.append([(r.kind, r.path, r.id) for r in e.collect()]))
    hint = lambda *p: spark.createDataFrame([("v", x, True) for x in p], "vault string, path string, renamed boolean")
    step(hint("a"), 0)
    step(hint("a", "c"), 1)
    assert seen == [[("modified", "a", "A")], [("moved", "c", "A")]]


def test_reconcile_batches_go_on_after_a_restart(spark, tmp_path):
    row = lambda p, i, ino, h: (p, i, 1, ino, 1, h)
    first = spark.createDataFrame([row("a", "A", 1, "x")], SNAPSHOT)
    seen, hint = [], spark.createDataFrame([("v", "a", True)], "vault string, path string, renamed boolean")
    for n, state in enumerate(["y", "y", "z"]):
        step = flows.reconcile_batches(
            spark, first, lambda s=state: spark.createDataFrame([row("a", None, 1, s)], SNAPSHOT), lambda e: seen.append([r.kind for r in e.collect()]), str(tmp_path / "kept")
        )
        step(hint, max(n - 1, 0))
    assert seen == [["modified"], ["modified"], ["modified"]]  # the first, the first again, and the change after it


# ------------------------------------------------------------------ hints by hand


def test_a_stream_of_hints_goes_on_after_a_restart_and_after_loss(spark, tmp_path):
    log, seen = hints.HintLog(f"file://{tmp_path}/log"), []

    def run():
        stream = hints.hint_stream(spark, log.path).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        stream.foreachBatch(lambda rows, n: seen.append(sorted((r.path, r.renamed) for r in rows.collect())) if not rows.isEmpty() else None).start().awaitTermination()
        got = [h for batch in seen for h in batch]
        seen.clear()
        return sorted(got)

    log.emit([("a", False), ("b/c", True), (None, True)])
    log.emit([("d", False)])
    assert run() == [("a", False), ("b/c", True), ("d", False)]
    assert run() == []
    log.emit_all(spark.createDataFrame([(f"p{i}", i == 3) for i in range(20)] + [(None, True), ("q", None)], "path string, renamed boolean").repartition(3))
    assert run() == sorted([(f"p{i}", i == 3) for i in range(20)] + [("q", False)])
    log.emit([("lost", True)])
    log.emit([("kept", True)])
    log.keep(1)
    assert run() == [("", False), ("kept", True)]
    log.emit([("lost as well", True)])
    log.keep(0)
    log.emit([("z", False)])
    assert run() == [("", False), ("z", False)]
    with open(f"{log.path}/{log._next()}.json", "w") as f:
        f.write('["half", tr')
    assert run() == [("", False)]


def test_a_changing_folder_by_hints(spark, tmp_path):
    """Created, modified, moved and deleted notes, over a restart, and a file that is being written."""
    root = tmp_path / "vault"
    (root / "sub").mkdir(parents=True)
    log, events = hints.HintLog(str(tmp_path / "log")), []
    first, unsettled = cut_lineage(notes.primed(notes.snapshot(spark, str(root)))), set()

    def now():
        return notes.census(spark, str(root)).withColumn("stable", F.col("stable") & ~F.col("path").isin(*unsettled, ""))

    def look(*paths, renamed=False):
        log.emit([(p, renamed) for p in paths])
        step = flows.reconcile_batches(spark, first, now, lambda e: events.extend((r.kind, r.path, r.old_path) for r in e.collect()), str(tmp_path / "kept"), lambda again: log.emit_all(again))
        stream = hints.hint_stream(spark, log.path).writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        stream.foreachBatch(step).start().awaitTermination()
        out, events[:] = sorted(events, key=repr), []
        return out

    (root / "a.md").write_text("a")
    (root / "sub" / "b.md").write_text("b")
    assert look("") == [("created", "a.md", None), ("created", "sub/b.md", None)]
    os.rename(root / "a.md", root / "sub" / "c.md")
    assert look("a.md", "sub", renamed=True) == [("moved", "sub/c.md", "a.md")]
    (root / "sub" / "b.md").write_text("being written")
    unsettled.add("sub/b.md")
    assert look("sub/b.md") == []
    unsettled.clear()
    (root / "d.md").write_text("d")
    assert look("d.md") == [("created", "d.md", None), ("modified", "sub/b.md", None)]
    os.remove(root / "d.md")
    assert look("") == [("deleted", "d.md", None)]


def test_files_that_change_while_they_are_read(tmp_path):
    path = tmp_path / "n.md"
    path.write_text("x")
    assert notes.stable_read(str(path))[3:] == (b"x", True)
    reads = []

    def meddled(p, until):
        reads.append(p)
        data = open(p, "rb").read()
        if len(reads) < until:
            path.write_text("x" * (len(reads) + 5))
        return data

    assert notes.stable_read(str(path), 4, lambda p: meddled(p, 3))[4] is True and len(reads) == 3
    reads.clear()
    assert notes.stable_read(str(path), 4, lambda p: meddled(p, 99))[3:] == (None, False) and len(reads) == 4
    assert notes.stable_read(str(tmp_path / "gone.md")) is None


def test_first_ids_are_the_same_whenever_they_are_given(spark, tmp_path):
    for name in ("a.md", "b.md"):
        (tmp_path / name).write_text(name)
    ids = lambda: sorted((r.path, r.id) for r in notes.primed(notes.snapshot(spark, str(tmp_path))).collect())
    assert ids() == ids() and len({i for _, i in ids()}) == 2


def test_a_worker_cuts_few_documents_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        passages = chunker.chunks(spark.createDataFrame([(k, f"# t\n\nbody {k}\n") for k in range(600)], "object long, text string"))
        assert int(spark.conf.get(key)) <= 256 and passages.select("object").distinct().count() == 600
    finally:
        spark.conf.set(key, had)


def test_hints_come_in_small_entries_and_are_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hints, "ENTRY", 6)
    log = hints.HintLog(str(tmp_path / "log"))
    log.emit_all(spark.range(20).select(F.concat(F.lit("p"), "id").alias("path"), F.lit(True).alias("renamed")).coalesce(1))
    sizes = [sum(1 for _ in open(tmp_path / "log" / n)) for n in os.listdir(tmp_path / "log") if n.endswith(".json")]
    assert sum(sizes) == 20 and max(sizes) <= 6
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(path):
        reads.add(1)
        return path

    row = lambda k: (f"n/{k}.md", f"i{k}", 1, k, 1, "h")
    columns = "path string, id string, dev int, ino long, nlink int, hash string"
    old, new = (spark.createDataFrame([row(k) for k in r], columns) for r in (range(6), range(1, 8)))
    out = []
    step = flows.reconcile_batches(spark, old, lambda: new, lambda e: out.extend((r.kind, r.path) for r in e.collect()), str(tmp_path / "kept"))
    given = spark.createDataFrame([("", False), ("n/0.md", True), (None, True)], "path string, renamed boolean").coalesce(1)
    step(given.select(seen("path").alias("path"), "renamed"), 0)
    assert sorted(out) == [("created", "n/6.md"), ("created", "n/7.md"), ("deleted", "n/0.md")]
    # a filter and what goes on may each ask for a value of the one read
    assert reads.value <= 6


def test_the_root_covers_all_paths_without_a_common_key(spark):
    paths = spark.createDataFrame([("a/x",), ("a/x",), ("/b",), ("",), (None,), ("c",)], "path string")
    told = lambda rows: {r.path: r.renamed for r in snapshot.hinted(paths, spark.createDataFrame(rows, "path string, renamed boolean")).collect()}
    assert told([("", False), ("a", True)]) == {"a/x": True, "/b": False, "": False, "c": False}
    assert told([("", None), ("c", False)]) == {"a/x": None, "/b": None, "": None, "c": False}
    assert told([("a/x", None), ("/b", True), (None, True)]) == {"a/x": None, "/b": True}


def test_a_task_without_hints_writes_no_entry(spark, tmp_path):
    log = hints.HintLog(str(tmp_path / "log"))
    log.emit_all(spark.createDataFrame([("a", True)], "path string, renamed boolean").repartition(4))
    log.emit_all(spark.createDataFrame([], "path string, renamed boolean").repartition(2))
    assert [open(f"{log.path}/{n}").read() for n in os.listdir(log.path) if n.endswith(".json")] == ['["a", true]\n']


def test_events_of_a_batch_plan_their_joins_once(spark):
    row = lambda k, ino: (f"n/{k}.md", f"i{k}", 1, ino, 1, "h")
    columns = "path string, id string, dev int, ino long, nlink int, hash string"
    old = spark.createDataFrame([row(k, k) for k in range(6)], columns)
    new = spark.createDataFrame([row(k, k) for k in range(1, 5)] + [row(9, 5)], columns)
    told = spark.createDataFrame([("n/9.md", True)], "path string, renamed boolean")
    once, again = snapshot.reconcile(old, new, told, stored), snapshot.reconcile(old, new, told)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert {(r.kind, r.path) for r in once.collect()} == {("deleted", "n/0.md"), ("moved", "n/9.md")}
    joins = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(once) == 2 < joins(again)
