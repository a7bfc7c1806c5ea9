"""The pipeline on tables that hold what a table may hold."""

import uuid

import pytest

import corpus_pipeline
from marginalia.session import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def sf_dir(spark):
    base = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"

    def write(rows, labels):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        return base

    return write


def test_an_empty_corpus(spark, sf_dir):
    where = sf_dir([], [])
    assert corpus_pipeline.run(spark, where).count() == 0


def test_a_corpus_of_odd_rows(spark, sf_dir):
    """No usable label, so nothing is rejected; one of each group of equal texts stays, and what stays is mixed and restored."""
    good = "a plain sentence that says something about rivers and the towns beside them number "
    rows = [(i, good + " ".join(str(i * k) for k in range(3, 40)), "en", "s", 1) for i in range(30)]
    rows += [(None, "nobody's text", None, None, None), (None, None, None, None, None), (7, "", "en", None, 0), (7, rows[7][1], "en", "s", 1), (8, None, None, "t", None)]
    rows += [(100, "w " * 60_000, "en", "u", 1), (101, "x" * 300_000, "en", "u", 1), (102, rows[3][1].upper(), "en", "s", 1)]
    where = sf_dir(rows, [(None, 1, 0), (3, None, 0), (4, 5, 0)])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    at = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
        path = f"{where}/{name}"
        docs.write.parquet(path)
        docs = at[name] = spark.read.parquet(path)
    assert at["quality"].count() == len(rows)
    low = lambda t: (t or "").lower()
    kept = [low(r.text) for r in at["exact_dedup"].collect()]
    assert sorted(kept) == sorted({low(t) for _, t, *_ in rows})
    assert {low(r.text) for r in at["near_dedup"].collect()} <= set(kept)
    assert at["encode"].count() == at["mix"].count() and at["encode"].where("NOT restored").count() == 0
    assert corpus_pipeline.run(spark, where).count() == at["encode"].count()
