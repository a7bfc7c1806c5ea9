"""Shards, collocations and whitening, held against brute force on small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import phrases, queries, sharding, whitening

SF = "/root/testdata/sf0.001"


# --- shards


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def greedy(texts, shards):
    """One unit after the other, in one place: the same law without Spark."""
    counts = Counter(t or "" for t in texts)
    unit = {}
    for t, n in counts.items():
        h = xxhash.xxh64(t.encode(), seed=42).intdigest()
        words = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        unit[t] = (np.array([n * (len(t.encode()) + 16), n * words, n], float), signed(h), signed(xxhash.xxh64(b"second", seed=h).intdigest()))
    capacity = np.maximum(sum(v for v, _, _ in unit.values()) / shards, 1e-9)
    level = {t: max(0, math.floor(-math.log((v / capacity).max()) / math.log(sharding.STEP))) for t, (v, _, _) in unit.items()}
    residual, out = np.ones((shards, 3)), {}
    for at in sorted(set(level.values())):
        some = [t for t in unit if level[t] == at]
        order = sorted(some, key=lambda t: (-unit[t][0][0] / capacity[0], -(unit[t][0] / capacity).sum(), unit[t][1], unit[t][2]))
        for t in order:
            item = unit[t][0] / capacity
            out[t] = best = int(np.argmax(residual @ (item * np.array(sharding.WEIGHTS))))
            residual[best] -= item
    return out


def check_slots(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shards_equal_a_sequential_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(10_000)
    for shards in (4, 13):
        rows = sharding.pack(docs, shards).join(docs, "doc_id").collect()
        want = greedy([r.text for r in rows], shards)
        assert all(r.shard == want[r.text or ""] for r in rows)
        check_slots(rows)


def test_shard_query(spark):
    out = queries.op11_balanced_shards(spark, "/root/testdata/sf0.01")
    assert {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} <= set(out.columns)
    rows = out.collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
    check_slots(rows)
    place = {}
    assert all(place.setdefault(texts[r.doc_id], r.shard) == r.shard for r in rows)
    for measure, slack in (("size", 0.05), ("words", 0.1)):
        sums = Counter()
        for r in rows:
            sums[r.shard] += r[measure]
        mean = sum(sums.values()) / 40
        assert len(sums) == 40 and all(abs(s - mean) <= slack * mean for s in sums.values())
    assert sorted(map(tuple, queries.op11_balanced_shards(spark, "/root/testdata/sf0.01").collect())) == sorted(map(tuple, rows))


def test_a_group_larger_than_a_shard_is_dealt(spark):
    rows = [(i, "the same text again") for i in range(700)] + [(None, f"text {i} " * (i % 7)) for i in range(800)] + [(5, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("shard", F.lit(9))
    out = sharding.pack(docs, 10).collect()
    assert len(out) == len(rows)
    check_slots(out)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    assert sharding.pack(docs.limit(0), 10).count() == 0
    alone = sharding.pack(docs.limit(0).unionByName(spark.createDataFrame([(1, None, "x", 1)], "doc_id long, text string, size string, shard int")), 3).collect()
    assert [(r["size"], r.slot) for r in alone] == [(16, 0)]


def test_many_chunks_of_a_class_stay_balanced(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 150)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.pack(docs, 8).collect()
    check_slots(out)
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) < 1.05 * min(sizes.values())


# --- collocations


def brute(rows, min_count, top, longest=3):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts.setdefault(lang, Counter())[" ".join(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if " " in p and a >= min_count}
        kept = []
        for p, a in found.items():
            w = p.split(" ")
            if any(f" {p} " in f" {q} " and q != p and 100 * b >= 50 * a for q, b in found.items()):
                continue
            cuts = [(10**6 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((-score, -a, p.encode(), p, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        for rank, (s, a, _, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p, -a, left, right, totals[lang], -s))
    return sorted(out)


TEXTS = [
    ("en", "The quick brown fox. the QUICK brown fox; the quick brown dog\x0bthe quick\tbrown"),
    ("en", "a a a a a a a a a a a a a a!a a a a"),
    (None, "x y z x y z x y z x y z x y z x y z"),
    ("", "new york new york, new york new york ÉtÉ new york"),
    ("en", None), ("en", ""), (None, None), ("de", "..;;!! \t "), ("en", "w" * 50_000),
] * 4


def test_a_prefix_is_dealt_to_few_parts(spark):
    """Each part is a row of each task that reads texts."""
    counts = spark.createDataFrame([("en", "some", 60_000), ("en", "many", 640_000)], "lang string, word string, n long")
    parts = phrases.parts_by_slot(counts)
    assert sorted(parts[parts > 0].tolist()) == [1, 10]


@pytest.mark.parametrize("task", [phrases.TASK, 3])
def test_collocations_equal_brute_force(spark, monkeypatch, task):
    monkeypatch.setattr(phrases, "TASK", task)
    docs = spark.createDataFrame([(lang, text, 1, 2) for lang, text in TEXTS], "lang string, text string, n int, phrase int").repartition(3)
    for longest in (2, 3, 5):
        got = phrases.collocations(docs, min_count=10, max_words=longest, top=7)
        assert sorted(map(tuple, got.collect())) == brute(TEXTS, 10, 7, longest)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_texts_in_bulk_whatever_a_worker_holds():
    """Segments, waiting positions and remembered words of a few: the same words in the same order."""
    read = [w for part in phrases.tokens(b"One two. three,four five six\nseven" * 3, 5) for w in part]
    assert read == b"one two . three . four five six . sevenone two . three . four five six . sevenone two . three . four five six . seven".split()
    shares = np.ones(1 << 10, np.int32)
    shares[phrases.slot(b"en", b"rare", 1 << 10)] = 0
    batches = [{"lang": pa.array(["en", "de", "en"]), "text": pa.array([b"a b rare c. d e", b"a b", b"f g h a " * 5], pa.binary())}] * 2

    def spoken(*most):
        out = {}
        for lang, words, ids in phrases._in_bulk(iter(batches), shares, *most):
            out.setdefault(lang, []).extend(words.names[i] if i >= 0 else None for i in ids)
        return out

    assert spoken() == spoken(3, 4) == spoken(1, 1000) == spoken(1000, 1)
    assert spoken()["en"][:8] == [b"a", b"b", None, b"c", None, b"d", b"e", None]


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


def test_growth_is_depth_first_and_stops_where_few_agree():
    seen = [("b c", 6), ("b d", 5), ("e", 3)]
    assert list(phrases.grow("a", 1, seen, 6, True)) == [("a b", 2, 11), ("a b c", 3, 6)]
    assert list(phrases.grow("a", 1, seen, 6, False)) == [("a b", 2, 11), ("a b c", 3, 6), ("a e", 2, 3)]


def test_crowded_tables_change_nothing(spark, monkeypatch):
    """With a handful of slots and bits every word and pair collides: rows grow, results don't."""
    monkeypatch.setattr(phrases, "SLOTS", 2)
    monkeypatch.setattr(phrases, "BITS", 64)
    docs = spark.createDataFrame(TEXTS, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == brute(TEXTS, 10, 2000)


# --- whitening


def brute_whitening(vectors, k):
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors], float)
    u = np.unique(x, axis=0)
    mean = u.mean(axis=0)
    e, v = np.linalg.eigh((u - mean).T @ (u - mean) / len(u))
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    s, n = [int(t) for t in u.sum(axis=0)], len(u)
    dev = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
    total = ((u - mean) ** 2).sum() / n
    return n, dev, (x - mean) @ v / np.sqrt(e), e / total


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    good = [list(map(float, r)) for r in rng.normal(size=(60, 5)) * np.array([3, 2, 1, 0.5, 0.25])]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, good[7]) for i in range(40)] + [(None, good[1]), (3, good[2])]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] + [0.0] * 4), (204, [1.0, 2.0]), (205, []), (206, [1e300] * 5)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("component", F.lit("clash")).withColumn("n", F.lit(0))
    out = whitening.whiten(vectors, k=4).collect()
    n, dev, w, share = brute_whitening([v for _, v in rows], 4)
    assert len(out) == 4 * len(rows) and {r.n for r in out} == {n} and n == 60
    assert Counter((r.vec_id, int(r.deviation)) for r in out) == Counter({k: 4 * c for k, c in Counter((i, d) for (i, _), d in zip(rows, dev)).items()})
    sign = {}
    at = {i: k for k, (i, _) in enumerate(rows) if i not in (3,)}
    for r in out:
        if r.vec_id in at:
            want = w[at[r.vec_id], r.component - 1]
            s = sign.setdefault(r.component, np.sign(r.whitened * want))
            assert abs(r.whitened - s * want) < 1e-9
        assert abs(r.explained - share[r.component - 1]) < 1e-12 and 0 <= r.identity_error < 1e-9


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    line = spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.5, 0.25]), (3, [2.5, 0.25])], "vec_id long, embedding array<float>")
    nothing = same.limit(0)
    assert whitening.whiten(same).count() == 0 and whitening.whiten(nothing).count() == 0
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    assert whitening.whiten(nothing).columns == whitening.whiten(line).columns


def test_whitening_query(spark):
    out = queries.op13_whitening(spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, dev, w, share = brute_whitening([v for _, v in vectors], 4)
    rows = {(r.vec_id, r.component): r for r in out.collect()}
    assert len(rows) == 4 * len(vectors)
    for c in range(4):
        got = np.array([rows[i, c + 1].whitened for i, _ in vectors])
        assert min(np.abs(got - w[:, c]).max(), np.abs(got + w[:, c]).max()) < 1e-8
    assert [rows[i, 1].deviation for i, _ in vectors] == dev
