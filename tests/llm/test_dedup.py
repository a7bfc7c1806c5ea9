"""Exact, SimHash, embedding and passage dedup against brute force, and on odd input."""

import hashlib
import random
import re
import string

import numpy as np
import pytest
import xxhash

from marginalia.llm import embedding_dedup, exact_dedup, graph, simhash, substring_dedup

DOCS = "doc_id long, text string, source string, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "own") for i, t in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def classes(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# ------------------------------------------------------------------ components


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (None, 3), (3, 4), (4, 3)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[100 + k] for k in range(60)} == {100}


def test_components_without_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ exact

ODD = [(1, "Abc"), (2, "aBC"), (9, "abc"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (10, " ")]


def test_exact_report(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs(spark, ODD)).collect()}
    for i, t in ODD:
        same = [j for j, u in ODD if lowered(u) == lowered(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (max(same), len(same), i == max(same))
        assert r.text_sha256 == hashlib.sha256(lowered(t).encode()).hexdigest()
    assert got[1].source == "s"


def test_exact_drop_and_repeats(spark):
    kept = exact_dedup.drop_copies(docs(spark, ODD))
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 8, 9, 10] and kept.columns == ["doc_id", "text", "source", "keep_id"]
    again = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (3, "b"), (None, "c"), (None, "c")]
    assert sorted(exact_dedup.drop_copies(docs(spark, again)).select("doc_id", "text").collect(), key=lambda r: r.text) == [(2, "a"), (3, "b"), (None, "c")]


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, simhash.drop_similar])
def test_a_text_is_kept_though_its_id_repeats_beside_a_copy(spark, drop):
    rows = [(5, "aa"), (5, "unique text"), (9, "AA"), (7, "other"), (None, "x"), (5, "unique text")]
    assert sorted(r.text.lower() for r in drop(docs(spark, rows)).collect()) == ["aa", "other", "unique text", "x"]


def test_exact_on_an_empty_table(spark):
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0 == exact_dedup.drop_copies(docs(spark, [])).count()


# ------------------------------------------------------------------ simhash


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 120))) for _ in range(n)]
    near = []
    for t in base[: n // 2]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return base + near


def test_simhash_against_brute_force(spark):
    rows = list(enumerate([*texts(60), None, "", "  one", "ONE two", "one TWO", "w " * 30_000, " \x1c "]))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows), budget=10).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    assert all(got[i].fingerprint == f"{fps[i]:016x}" for i, _ in rows)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 10]
    assert [got[i].component_id for i, _ in rows] == classes(len(rows), links) and links


def test_large_nodes_are_split_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    flips = [int(base[i]) ^ (1 << int(rng.integers(60))) ^ (1 << int(rng.integers(60))) for i in range(200)]
    shared = [int(base[0]) ^ k for k in range(200)]
    values = sorted({int(x) for x in base} | set(flips) | set(shared))
    monkeypatch.setattr(simhash, "NODE_ROWS", 8)
    monkeypatch.setattr(simhash, "OUTRIGHT", 4)
    got = dict(graph.components(simhash.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 4)).collect())
    links = [(i, j) for i in range(len(values)) for j in range(i) if bin((values[i] ^ values[j]) & (1 << 64) - 1).count("1") <= 4]
    want = classes(len(values), links)
    by_root = {}
    for v, c in zip(values, want):
        by_root.setdefault(c, set()).add(got.get(v, v))
    assert all(len(s) == 1 for s in by_root.values()) and len(set().union(*by_root.values())) == len(by_root)


def test_simhash_on_an_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def jaccard(a, b, width=5):
    s = lambda t: {" ".join(t.split()[i : i + width]) for i in range(max(1, len(t.split()) - width + 1))}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_similar_documents_reach_the_similarity_and_no_others(spark):
    rows = list(enumerate(texts(80, seed=5)))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8]
    want = classes(len(rows), links)
    got = dict(simhash.similar_documents(docs(spark, rows)).collect())
    assert [got.get(i, i) for i, _ in rows] == want and len(links) > 20
    kept = simhash.drop_similar(docs(spark, rows)).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_large_classes_of_near_copies_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_SHINGLES", 1200)
    monkeypatch.setattr(simhash, "TASK_SHINGLES", 2400)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(1 + i % 4):
            words[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    want = classes(60, [(i, j) for i in range(60) for j in range(i) if jaccard(rows[i][1], rows[j][1]) >= 0.8])
    got = dict(simhash.similar_documents(docs(spark, rows)).collect())
    assert [got.get(i, i) for i in range(60)] == want and 1 <= len(set(want)) < 40


def test_similar_documents_on_odd_input(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, ""), (4, None), (5, "  "), (6, "z")]
    assert sorted((r.doc_id or 0) for r in simhash.drop_similar(docs(spark, rows)).collect()) == [0, 1, 3, 6]
    assert simhash.drop_similar(docs(spark, [])).count() == 0


# ------------------------------------------------------------------ embeddings


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(260, 24))
    x[100:180] = x[0] + rng.normal(scale=0.05, size=(80, 24))
    x[200] = x[1] * 3
    labels = [int(v) for v in rng.integers(0, 2, len(x))]
    labels[0], labels[1], labels[200] = 0, 1, 1
    rows = [(i, [float(v) for v in x[i]], labels[i]) for i in range(len(x))]
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("nan")] + [1.0] * 23, 0), (903, rows[0][1], None), (904, [1.0, 2.0], 0), (905, [], 1), (906, [None] + [1.0] * 23, 1)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, threshold=0.93).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :]) & ~np.eye(len(x), dtype=bool)
    want = classes(len(x), [(int(i), int(j)) for i, j in zip(*np.nonzero(close))])
    assert [got[i].n_links for i in range(len(x))] == close.sum(axis=1).tolist() and close.sum() > 500
    assert [got[i].component_id for i in range(len(x))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _, _ in odd)
    assert len(got) == len(rows) + len(odd)


def test_embeddings_of_repeated_ids_and_rows(spark, monkeypatch):
    """Every row of the table has its own links: against brute force over rows, whatever their ids."""
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6))
    x[30:60] = x[:30] + rng.normal(scale=0.08, size=(30, 6))
    ids = [int(i) for i in rng.integers(0, 40, len(x))]
    at = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0, 0.0, 0.0, 0.0]
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, x)] + [(5, at(0.0)), (5, at(3.0)), (6, at(0.1)), (7, at(0.2)), (8, at(3.1))]
    rows += [rows[0], rows[0], (77, rows[0][1]), (None, rows[0][1])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int"), threshold=0.93).collect()
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    usable = np.array([i is not None for i, _ in rows])
    close = (u @ u.T >= 0.93 - 1e-12) & usable[:, None] & usable[None, :] & ~np.eye(len(rows), dtype=bool)
    root = classes(len(rows), [(int(i), int(j)) for i, j in zip(*np.nonzero(close))])
    least = {r: min(i for (i, _), q in zip(rows, root) if q == r and i is not None) if usable[r] else None for r in set(root)}
    want = sorted((((i, int(n), least[r], least[r] == i)) for (i, _), n, r in zip(rows, close.sum(axis=1), root)), key=repr)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=repr) == want


def test_many_copies_of_one_vector_cost_as_one(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 64)
    copies = spark.range(100_000).selectExpr("id AS vec_id", "array(1D, 2D, 3D) AS embedding", "1 AS label")
    more = spark.createDataFrame([(200_000, [1.0, 2.0, 3.01], 1), (200_001, [-1.0, 0.0, 0.0], 1), (200_002, [1.0, 2.0, 3.0], 2), (7, [0.0, 1.0, 0.0], 1)], copies.schema)
    got = embedding_dedup.near_duplicates(copies.unionByName(more)).groupBy("n_links", "component_id").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 7, 1), (0, 200_001, 1), (0, 200_002, 1), (100_000, 0, 100_001)]


def test_tiles_meet_where_their_vectors_may(spark):
    rng = np.random.default_rng(6)
    boxes = [(i, *np.sort(rng.uniform(-1, 1, 2)).tolist(), *np.sort(rng.uniform(-1, 1, 2)).tolist()) for i in range(60)]
    tiles = spark.createDataFrame([(1, 3, i, *b, i, 0, 0) for i, *b in boxes], "label long, dim int, tile long, lo double, hi double, lo2 double, hi2 double, slice long, sub long, part long")
    gap = lambda a, b: max(a[0] - b[1], b[0] - a[1], 0.0)
    for reach in (0.05, 0.4):
        got = sorted((r.tile, r.tile_b) for r in embedding_dedup._meeting(tiles, reach).collect())
        assert got == [(i, j) for i, *a in boxes for j, *b in boxes if i <= j and gap(a[:2], b[:2]) ** 2 + gap(a[2:], b[2:]) ** 2 <= reach**2]


def test_embeddings_with_text_labels(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def test_embeddings_on_an_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ------------------------------------------------------------------ passages


@pytest.mark.parametrize("length", [3, 7, 20])
def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree(length):
    rng = np.random.default_rng(length)
    v = rng.choice(1 << 40, 200, replace=False).astype(np.uint64) << np.uint64(20)
    want = []
    for c in range(len(v)):
        l = c
        while l and v[l - 1] > v[c]:
            l -= 1
        r = c
        while r + 1 < len(v) and v[r + 1] > v[c]:
            r += 1
        if r - l + 1 >= length:
            want.append((c, l, r))
    assert list(zip(*(a.tolist() for a in substring_dedup.compact_windows(v, length)))) == want


def test_passages_that_repeat_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    passage, line = [word() for _ in range(56)], [word() for _ in range(9)]
    rows = []
    for i in range(40):
        body = [word() for _ in range(rng.randint(60, 150))]
        if i % 4 == 0:
            at = rng.randrange(len(body))
            body[at:at] = [w.upper() for w in passage] if i % 8 else passage
        if i % 3 == 0:
            body += line
        rows.append((i, " ".join(body)))
    edited = list(passage)
    edited[3] = "other"
    rows += [(50, " ".join(edited)), (51, " ".join(passage[:40])), (52, None), (53, ""), (None, rows[0][1]), (0, rows[0][1])]
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == {i for i in range(1, 40) if i % 4 == 0} | {50}
    assert all(r.other_id < r.doc_id and r.similarity >= 0.8 for r in got)
    texts_ = dict(r for r in rows if r[0] is not None)
    for r in got:
        assert texts_[r.doc_id].lower().split()[r.start_word : r.end_word][10] in [w.lower() for w in passage]


def test_hot_passages_are_salted(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LOOK", 1)
    monkeypatch.setattr(substring_dedup, "SALTS", 4)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=6))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)])) for i in range(60)]
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(1, 60))


def test_a_smaller_document_that_holds_a_part_of_a_passage_hides_no_repeat(spark):
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(n)]
    rows = []
    for i in range(0, 90, 3):
        passage = words(50)
        rows += [(i, " ".join(passage[:40] + words(20))), (i + 1, " ".join(words(30) + passage)), (i + 2, " ".join(passage + words(25)))]
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.other_id) for r in got) == [(i + 2, i + 1) for i in range(0, 90, 3)]
    assert all((r.start_word, r.end_word, r.other_start, r.other_end, r.similarity) == (0, 50, 30, 80, 1.0) for r in got)


def test_near_copies_behind_a_part_of_their_passage_are_found(spark):
    """An edited part in the smallest document, a passage, and the passage with one word changed."""
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(n)]
    rows, n = [], 150
    for i in range(0, 3 * n, 3):
        passage = words(55)
        changed = [*passage]
        changed[rng.randrange(8, 47)] = "changed"
        rows += [(i, " ".join(passage[:42] + words(30))), (i + 1, " ".join(words(30) + passage)), (i + 2, " ".join(changed + words(25)))]
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert all(r.doc_id == r.other_id + 1 and r.doc_id % 3 == 2 for r in got)
    assert len({r.doc_id for r in got}) >= 0.98 * n


def test_a_repeat_beside_an_edited_passage_in_the_smallest_document_is_found(spark):
    rng = random.Random(22)
    words = lambda n: ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(n)]
    rows, n = [], 100
    for i in range(0, 3 * n, 3):
        passage = words(55)
        edited = [w if k not in (15, 35) else "edited" for k, w in enumerate(passage)]
        rows += [(i, " ".join(edited + words(30))), (i + 1, " ".join(words(30) + passage)), (i + 2, " ".join(words(9) + passage + words(25)))]
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got if r.other_id == r.doc_id - 1} >= {i + 2 for i in range(0, 3 * n, 3)}


def test_a_passage_behind_many_documents_that_hold_its_parts_is_found(spark):
    """The smallest document of every key and the two before the passage hold parts alone; one between them holds it."""
    rng = random.Random(23)
    words = lambda n: ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(n)]
    rows, n = [], 30
    for i in range(0, 5 * n, 5):
        passage = words(55)
        parts = lambda: " ".join(words(30) + passage[:40] + words(50) + passage[8:48] + words(50) + passage[15:])  # noqa: B023, E731
        rows += [(i, parts()), (i + 1, " ".join(words(30) + passage)), (i + 2, parts()), (i + 3, parts()), (i + 4, " ".join(words(9) + passage + words(25)))]
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(i + 4, i + 1) for i in range(0, 5 * n, 5)}


def test_the_last_round_gives_each_window_one_cover(spark, monkeypatch):
    """Many documents that hold parts of a passage, and many that hold it: a row or two for each of those, not one for each pair."""
    monkeypatch.setattr(substring_dedup, "ROOM", 1 << 14)
    rng = random.Random(24)
    words = lambda n: ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(n)]
    passage, n = words(55), 40
    parts = lambda: " ".join(words(30) + passage[:40] + words(50) + passage[8:48] + words(50) + passage[15:])
    rows = [(i, parts()) for i in range(n)] + [(n, " ".join(words(30) + passage))] + [(i, parts()) for i in range(n + 1, 2 * n)]
    rows += [(i, " ".join(words(i % 7) + passage + words(25))) for i in range(2 * n, 3 * n)]
    taken = []
    passages = substring_dedup.remaining_passages
    monkeypatch.setattr(substring_dedup, "remaining_passages", lambda *a: taken.append(passages(*a)) or taken[0])
    got = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(2 * n, 3 * n)) and all(r.other_id == n or r.other_id >= 2 * n for r in got)
    # all pairs of what holds the passage would be 780
    assert taken and taken[0].count() <= 6 * n


def test_windows_of_many_texts_are_those_of_each():
    rng = random.Random(25)
    words = lambda n, m: " ".join("".join(rng.choices("abc", k=m)) for _ in range(n))
    texts = [words(rng.randint(0, 200), rng.choice((1, 4, 9))) for _ in range(60)] + [None, "", "same " * 300]
    which, key, at = substring_dedup.text_windows(texts, 46, 3, 28)
    for k, text in enumerate(texts):
        alone = substring_dedup.text_windows([text], 46, 3, 28)
        assert (alone[1] == key[which == k]).all() and (alone[2] == at[which == k]).all() and len(set(alone[1].tolist())) == len(alone[1])
    assert set(which.tolist()) == {k for k, t in enumerate(texts) if len((t or "").split()) >= 50}


def test_windows_agree_where_their_beginnings_meet():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, length = 9, 6
        c, d = rng.integers(10, 40, n), rng.integers(10, 40, n)
        kinds = rng.choice([0, 1, 2], n)
        pack = lambda x: np.array([int(substring_dedup.packed(x[i : i + 1], x[i : i + 1] - rng.integers(0, 9), x[i : i + 1] + rng.integers(0, 9), int(kinds[i]))[0]) for i in range(n)])
        at, other = pack(c), pack(d)
        (a0, a1), (b0, b1) = substring_dedup.beginnings(at, length), substring_dedup.beginnings(other, length)
        want = np.zeros(n, bool)
        for x in range(60):
            for y in range(60):
                here = (a0 <= x) & (x <= a1) & (b0 <= y) & (y <= b1)
                if len(set(kinds[here])) >= 2:
                    want |= here
        assert (substring_dedup.agreeing(at, other, length, 2) == want).all()


def test_passages_in_very_long_and_repetitive_texts(spark):
    rng = random.Random(31)
    words = lambda n: ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(n)]
    passage = words(60)
    rows = [(1, " ".join(words(120_000) + passage)), (2, " ".join(passage + words(90_000))), (3, "same " * 50_000), (4, "same " * 40_000), (5, "x" * 1_000_000)]
    got = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(docs(spark, rows)).collect()}
    assert got == {(2, 1), (4, 3)}


def test_passages_with_a_changed_word_are_found(spark):
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(n)]
    rows, pairs = [], 400
    for i in range(0, 2 * pairs, 2):
        passage = words(50)
        changed = [*passage]
        changed[rng.randrange(5, 45)] = "changed"
        rows += [(i, " ".join(words(60) + passage + words(60))), (i + 1, " ".join(words(60) + changed + words(60)))]
    got = {r.doc_id for r in substring_dedup.repeated_passages(docs(spark, rows)).collect()}
    assert len(got) >= 0.99 * pairs and all(i % 2 for i in got)


def test_passages_on_an_empty_table(spark):
    assert substring_dedup.repeated_passages(docs(spark, [])).count() == 0


def test_passages_longer_than_windows_can_be_are_refused(spark):
    for words in (2001, 4):
        with pytest.raises(ValueError):
            substring_dedup.repeated_passages(docs(spark, [(1, "a")]), min_words=words)


def test_passages_against_brute_force(spark):
    """All pairs of documents that share a shingle: those with a window of fifty words that is similar to 0.8 are found."""
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    long = next(t for t in rows.values() if len(t.split()) > 200).split()
    near = long[60:120]
    near[20] = "changed"
    rows |= {10_001: " ".join(long[60:130]), 10_002: "first other words " + " ".join(near) + " and more", 10_003: " ".join(long[60:105])}
    got = substring_dedup.repeated_passages(docs(spark, list(rows.items()))).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    shingles = {i: [" ".join(w[k : k + 5]) for k in range(len(w) - 4)] for i, w in ((i, words(t)) for i, t in rows.items())}
    at = {}
    for i, s in shingles.items():
        for k, x in enumerate(s):
            at.setdefault(x, []).append((i, k))
    diagonals = {}
    for places in at.values():
        for i, k in places:
            for j, m in places:
                if j < i:
                    diagonals.setdefault((i, j, k - m), []).append(k)
    share = set()
    for (i, _, _), ks in diagonals.items():
        ks = sorted(ks)
        # 41 equal shingles of 46 are 41 of 51 different ones
        if any(ks[k + 40] - ks[k] < 46 for k in range(len(ks) - 40)):
            share.add(i)
    found = {r.doc_id for r in got}
    assert len(share) > 5 and {10_001, 10_002} <= share and len(share & found) >= 0.95 * len(share)
    for r in got:
        a, b = set(shingles[r.doc_id][r.start_word : r.end_word - 4]), set(shingles[r.other_id][r.other_start : r.other_end - 4])
        assert r.other_id < r.doc_id and len(a & b) / len(a | b) >= 0.8 and r.end_word - r.start_word >= 41  # without what is changed at either end


def test_texts_that_share_few_shingles_in_a_part_are_not_close():
    a, few = np.arange(100, dtype=np.uint64), np.arange(30, dtype=np.uint64)
    for n in range(31):
        assert not len(substring_dedup._close(a, few[:n], np.zeros(n, np.int32), 1, 46, 40))
    key, at, bare = np.array([5]), np.array([60 << 25]), np.array([60])
    asked = substring_dedup.Listed(9, a, key, at, bare)
    other = substring_dedup.Listed(2, np.concatenate((few, a[50:] + np.uint64(1000))), key, at, bare)
    assert not list(substring_dedup.first_covers([asked], [other], 46, 0.8, 1))
    same = substring_dedup.Listed(3, a[10:], key, np.array([50 << 25]), bare)
    assert [r[3] for r in substring_dedup.first_covers([asked], [other, same], 46, 0.8, 1)] == [3]
