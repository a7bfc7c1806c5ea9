"""An index from notes to answers, rebuilt, merged and grouped."""

from marginalia.plans import verbs

NOTES = {
    "bread.md": "# Bread\n\nFlour water salt and yeast make a dough that rises overnight in the cold kitchen.\n",
    "tides.md": "# Tides\n\nThe moon pulls the ocean and the harbour fills twice a day at spring tide.\n",
    "loom.md": "# Loom\n\nWarp threads are strung tight before the weft is woven through with a shuttle.\n",
}


def table(spark, notes):
    return spark.createDataFrame(list(notes.items()), "object string, text string")


def test_an_index_lives(spark, tmp_path):
    index, notes = str(tmp_path / "index"), table(spark, NOTES)
    first = verbs.build(notes, index).first()
    assert (first.added, first.notes, first.buried, first.embedded) == (3, 3, 0, 3)
    again = verbs.build(notes, index).first()
    assert (again.added, again.buried, again.embedded) == (0, 0, 0)

    asked = spark.createDataFrame(
        [(1, "make a dough that rises overnight", "dough"), (2, "moon pulls the ocean", "ocean"), (3, "quantum chromodynamics lattice", None)], "q long, question string, expected string"
    )
    got = verbs.evaluate(asked, notes, index, floor=0.2).first()
    assert (got.asked, got.answerable, got.hit1, got.refusals, got.correct_refusals) == (3, 2, 2, 1, 1)

    changed = NOTES | {"tides.md": "# Tides\n\nA storm surge adds to the tide and floods the quay.\n"}
    del changed["loom.md"]
    second = verbs.build(table(spark, changed), index).first()
    assert (second.added, second.notes, second.buried, second.embedded) == (1, 1, 2, 1)
    s = verbs.stats(spark, index).first()
    assert (s.segments, s.vectors, s.tombstoned, s.objects) == (4, 4, 2, 2)

    before = sorted(map(tuple, verbs.entries(spark, index).select("object", "start", "end").collect()))
    merged = verbs.compact(spark, index, min_segments=2).first()
    assert merged.rows == 2 and merged.segments >= 2
    assert sorted(map(tuple, verbs.entries(spark, index).select("object", "start", "end").collect())) == before
    assert verbs.build(table(spark, changed), index).first().added == 0
    reverted = changed | {"tides.md": NOTES["tides.md"]}
    assert verbs.build(table(spark, reverted), index).first().added == 1
    assert sorted({r.object for r in verbs.entries(spark, index).collect()}) == ["bread.md", "tides.md"]
    assert sum(r.chunks for r in verbs.topic_report(spark, index, 2).collect()) == 2


def test_a_build_embeds_what_changed(spark, tmp_path):
    """Notes that are emptied, taken away, brought back as they were, or embedded in another width."""
    index = str(tmp_path / "index")
    did = lambda notes, **more: tuple(verbs.build(table(spark, notes), index, **more).select("added", "buried", "embedded").first())
    objects = lambda: sorted({r.object for r in verbs.entries(spark, index).collect()})
    assert did(NOTES) == (3, 0, 3)
    assert did(NOTES | {"loom.md": ""}) == (0, 1, 1) and objects() == ["bread.md", "tides.md"]
    less = {k: v for k, v in NOTES.items() if k != "tides.md"}
    assert did(less) == (1, 1, 1) and objects() == ["bread.md", "loom.md"]
    assert did(NOTES) == (1, 0, 1) and objects() == sorted(NOTES)
    assert did(NOTES) == (0, 0, 0)
    assert did(NOTES, dimension=32)[2] == 3


def test_a_build_that_broke_off_is_done_again(spark, tmp_path, monkeypatch):
    index, append = str(tmp_path / "index"), verbs._append

    def breaks(rows, where, name, *by):
        if name == "notes":
            raise OSError("gone")
        append(rows, where, name, *by)

    monkeypatch.setattr(verbs, "_append", breaks)
    try:
        verbs.build(table(spark, NOTES), index)
    except OSError:
        pass
    monkeypatch.setattr(verbs, "_append", append)
    again = verbs.build(table(spark, NOTES), index).first()
    assert (again.added, again.buried, again.embedded) == (0, 0, 3)
    assert verbs.entries(spark, index).count() == 3
