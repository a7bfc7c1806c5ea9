"""SimHash near-dedup by a binary trie self-join of 64-bit fingerprints.

The join walks pairs of trie nodes together from the root, adds up the bits in
which the two prefixes differ, and drops a pair as soon as the sum is over the
budget. To spread it, the 64 bits are cut into ``budget + 1`` blocks. Two
fingerprints within the budget agree on a whole block, so of the tries that start
with block 1, 2, ... one holds the two below the same node after that block: each
such node is a piece of work of its own, entered with nothing spent. The rows of a
node with more than ``NODE_ROWS`` are dealt to groups, and every two groups are
walked together, so that no task depends on the size of one node.

Inside a task the walk goes over sorted arrays, many node pairs at a time and
depth first, so its memory is bounded by the slice; found links are merged at
once and only a spanning link per fingerprint leaves the task.

``near_duplicates`` links 64-bit fingerprints within a few bits. ``similar_documents``
is for a similarity of shingle sets: at 0.8 two 64-bit fingerprints differ in ten
bits or so, as unrelated ones sometimes do in a large corpus. It takes 256 bits, of
which unrelated texts never agree on as many, and as roots of its tries the min-hash
bands of the shingle sets: the same walk, entered at nodes that similar texts share.
The classes that this gives are then walked once more with the shingle sets at hand,
and only pairs whose exact similarity reaches the threshold stay linked. Pairs that
are already connected are not compared, so a class of true copies costs little more
than one comparison a member.

Defined results
    null or empty text   no words: fingerprint 0, linked like any other
    few words            the whole sequence is the one shingle
    equal fingerprints   one vertex; their documents share a component
    repeated rows        the same fingerprint, the same component
    null id              never a component's id unless all its ids are null
    repeated ids         ``drop_similar`` takes each row for a document of its own
    chains               a class is what links reach: of a chain one document stays,
                         also where its ends are not alike
    empty table          an empty result
    other columns        ``fingerprint`` and ``drop_similar`` carry them through, the
                         reports keep the id alone
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.graph import components, union, with_value
from marginalia.session import bounded_batches, cut

SEED = 42
#: Fingerprints below one node that go to one task, node pairs in a slice, and the product of sizes compared outright.
NODE_ROWS, SLICE, OUTRIGHT = 1 << 14, 1 << 18, 512


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle as rows of eight bytes, most significant first."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty((0, 8), np.uint8)
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) <= width:
        parts = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width])).tolist()
        parts = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 8)


def text_fingerprint(text: str | None, width: int) -> int:
    """As a signed 64-bit number."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(docs: DataFrame, text_col: str = "text", width: int = 4) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a long."""

    @F.pandas_udf(T.LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, width) for t in texts], dtype="int64")

    bounded_batches(docs.sparkSession)
    return docs.withColumn("fp", of(F.col(text_col)))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def blocks(budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` blocks of the 64 bits as (first bit, bits)."""
    cuts = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _at_blocks(fps: DataFrame, budget: int) -> DataFrame:
    """Each fingerprint once a block, rotated so that the block leads: ``k, head, depth, turned, key``."""
    left = lambda c, n: F.call_function("shiftleft", c, F.lit(n)) if n else c
    right = lambda c, n: F.shiftrightunsigned(c, n) if n < 64 else F.lit(0).cast("long")
    turned = [
        F.struct(
            F.lit(k).alias("k"),
            right(left(F.col("fp"), at), 64 - bits).alias("head"),
            F.lit(bits).alias("depth"),
            (left(F.col("fp"), at).bitwiseOR(right(F.col("fp"), 64 - at))).alias("turned"),
        )
        for k, (at, bits) in enumerate(blocks(budget))
    ]
    return fps.select(F.col("fp").alias("key"), F.explode(F.array(*turned)).alias("t")).select("t.*", "key")


def _node_pairs(rows: DataFrame, most: int | None = None, weight: Column | None = None) -> DataFrame:
    """``node`` names a trie node, entered at ``depth`` with nothing spent.

    The rows of a node that weigh more than ``most``, NODE_ROWS if not given, are dealt
    to groups by a hash, and every two groups become a piece of their own: near copies
    share their leading bits, so going further down would leave them together. A row
    weighs 1 if nothing else is said.
    """
    most = most or NODE_ROWS
    full = rows.groupBy("k", "head").agg(F.sum(F.lit(1) if weight is None else weight).alias("count")).where(F.col("count") > most)
    split = F.ceil(F.col("count") / most).cast("long")
    rows = rows.join(full.select("k", "head", split.alias("groups")), ["k", "head"], "left").fillna(1, ["groups"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key", F.lit("deal")), F.col("groups")))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).select(
        F.xxhash64("k", "head", F.least("own", "other"), F.greatest("own", "other")).alias("node"),
        (F.col("own") > F.col("other")).cast("byte").alias("side"),
        (F.col("own") == F.col("other")).alias("alone"),
        F.col("depth").cast("byte").alias("depth"),
        F.lit(0).cast("byte").alias("spent"),
        *[c for c in ("turned", "key", "wide", "shingles") if c in rows.columns],
    )


def _halves(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Where in each range of sorted values the bit at ``level`` turns to 1."""
    lo, hi, shift = lo.copy(), hi.copy(), (63 - level).astype(np.uint64)
    while True:
        going = lo < hi
        if not going.any():
            return lo
        mid = (lo + hi) >> 1
        zero = ((values[np.minimum(mid, len(values) - 1)] >> shift) & np.uint64(1)) == 0
        lo = np.where(going & zero, mid + 1, lo)
        hi = np.where(going & ~zero, mid, hi)


def trie_join(values: np.ndarray, pairs: np.ndarray, budget: int, found) -> None:
    """Walk node pairs ``(a0, a1, b0, b1, level, spent)`` over sorted ``values``; report index pairs."""
    stack = [pairs[i : i + SLICE] for i in range(0, len(pairs), SLICE)]
    while stack:
        p = stack.pop()
        size = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2])
        small = (size <= OUTRIGHT) | (p[:, 4] >= 64)
        leaf = p[small]
        n = size[small]
        if len(leaf):
            at = np.repeat(np.arange(len(leaf)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            width = (leaf[:, 3] - leaf[:, 2])[at]
            i, j = leaf[at, 0] + k // width, leaf[at, 2] + k % width
            near = (np.bitwise_count(values[i] ^ values[j]) <= budget) & (i != j)
            found(i[near], j[near])
        p = p[~small]
        if not len(p):
            continue
        a, b = _halves(values, p[:, 0], p[:, 1], p[:, 4]), _halves(values, p[:, 2], p[:, 3], p[:, 4])
        level, spent, own = p[:, 4] + 1, p[:, 5], (p[:, 0] == p[:, 2]) & (p[:, 1] == p[:, 3])
        zeros = np.stack([p[:, 0], a, p[:, 2], b, level, spent], 1)
        ones = np.stack([a, p[:, 1], b, p[:, 3], level, spent], 1)
        cross = np.stack([p[:, 0], a, b, p[:, 3], level, spent + 1], 1)
        back = np.stack([a, p[:, 1], p[:, 2], b, level, spent + 1], 1)[~own]
        below = np.concatenate([zeros, ones, cross, back])
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 5] <= budget)]
        stack += [below[i : i + SLICE] for i in range(0, len(below), SLICE)]


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold; two empty sets are alike."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _spanning(budget: int, wide_budget: int | None = None, similarity: float | None = None):
    """A task: walk the node pairs it was dealt and report links that span what they connect."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        node, side, depth, spent, turned, key = (
            t[c].to_numpy() for c in ("node", "side", "depth", "spent", "turned", "key")
        )
        alone = t["alone"].to_numpy()
        turned = turned.view(np.uint64)
        order = np.lexsort((turned, side, node))
        node, side, depth, spent, turned, key, alone = (x[order] for x in (node, side, depth, spent, turned, key, alone))
        first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (side[1:] != side[:-1])])
        last = np.r_[first[1:], len(node)]
        own = alone[first]
        one = np.stack([first, last, first, last, depth[first], spent[first]], 1)[own]
        two = np.flatnonzero(~own[:-1] & (node[first[:-1]] == node[first[1:]]))
        both = np.stack([first[two], last[two], first[two + 1], last[two + 1], depth[first[two]], spent[first[two]]], 1)
        keys, index = np.unique(key, return_inverse=True)
        label = np.arange(len(keys))
        if wide_budget is not None:
            packed = np.frombuffer(b"".join(t["wide"].to_pylist()), np.uint64)
            wide = packed.reshape(len(order), -1)[order] if len(order) else packed.reshape(0, 1)

        if similarity is not None:
            sets = t["shingles"].combine_chunks()
            values, edges = sets.values.to_numpy(), sets.offsets.to_numpy()
            members = [values[edges[k] : edges[k + 1]] for k in order]

        def found(i: np.ndarray, j: np.ndarray) -> None:
            apart = label[index[i]] != label[index[j]]
            i, j = i[apart], j[apart]
            if wide_budget is not None:
                close = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1, dtype=np.int64) <= wide_budget
                i, j = i[close], j[close]
            if similarity is None:
                union(label, index[i], index[j])
                return
            for at in range(0, len(i), 64):
                x, y = i[at : at + 64], j[at : at + 64]
                apart = label[index[x]] != label[index[y]]
                x, y = x[apart], y[apart]
                like = np.array([_similar(members[a], members[b], similarity) for a, b in zip(x, y)], bool)
                union(label, index[x[like]], index[y[like]])

        trie_join(turned, np.concatenate([one, both]).astype(np.int64), budget, found)
        joined = np.flatnonzero(label != np.arange(len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[joined]), pa.array(keys[label[joined]])], ["a", "b"])

    return task


def _deal(nodes: DataFrame, rows: int, task, each: int = 1_000_000) -> DataFrame:
    """Deal node pairs to tasks of about ``each`` rows and run ``task`` on each."""
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
    return nodes.repartition(tasks, "node").mapInArrow(task, "a long, b long")


def fingerprint_links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """Distinct ``fps(fp)`` to ``a, b``: links that span every class within ``budget`` bits."""
    return _deal(_node_pairs(_at_blocks(fps, budget)), fps.count() * (budget + 1), _spanning(budget))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4
) -> DataFrame:
    """Every id of ``docs`` with ``fingerprint`` (hex) and ``component_id``."""
    marked = cut(fingerprint(docs.select(id_col, text_col), text_col, width).select(id_col, "fp"))
    classes = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(fingerprint_links(classes.select("fp"), budget)).select(F.col("id").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = with_value(rooted.select("fp", "root"), least, "root", "fp").select("fp", "component_id")
    return marked.join(component, "fp").select(id_col, as_hex(F.col("fp")).alias("fingerprint"), "component_id")


#: Bits of a wide fingerprint, the most that differ at the stated similarity, the same for one 64-bit word of it.
WIDE_BITS, WIDE_BUDGET, WORD_BUDGET = 256, 72, 24
#: Shingles whose sets go to one task, and those of one class in one of its pieces; a set counts for SET_LEAST at least.
TASK_SHINGLES, NODE_SHINGLES, SET_LEAST = 8_000_000, 500_000, 128
#: Bands of min-hashes: a pair of similarity 0.8 shares none of them once in 5,000 pairs.
BANDS, BAND_WIDTH = 12, 3
_MIX = np.random.default_rng(SEED).integers(1, 1 << 63, (2, BANDS * BAND_WIDTH + WIDE_BITS // 64), dtype=np.uint64) * 2 + 1


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct shingle hashes as unsigned numbers."""
    return np.unique(shingle_hashes(text, width).copy().view(">u8").ravel().astype(np.uint64))


def _mixed(shingles: np.ndarray, k: int) -> np.ndarray:
    x = (shingles ^ _MIX[0, k]) * _MIX[1, k]
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """256 bits: each the majority over the set of a bit of its hashes."""
    words = []
    for k in range(WIDE_BITS // 64):
        set_bits = np.zeros(64, np.int64)
        for at in range(0, len(shingles), 1 << 16):
            mixed = _mixed(shingles[at : at + (1 << 16)], BANDS * BAND_WIDTH + k)
            set_bits += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        words.append(np.packbits(2 * set_bits > len(shingles)).tobytes())
    return b"".join(words)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One number for each band of min-hashes; a text without words has a band of its own kind."""
    least = [int(_mixed(shingles, k).min()) if len(shingles) else 0 for k in range(BANDS * BAND_WIDTH)]
    rows = np.array(least, np.uint64).reshape(BANDS, BAND_WIDTH)
    return [xxhash.xxh64_intdigest(r.tobytes(), SEED) - (1 << 63) for r in rows]


def _wide_rows(marked: DataFrame) -> DataFrame:
    """``turned``: the first word of the wide fingerprint, by which tries are walked."""
    return marked.withColumn("turned", F.conv(F.hex(F.substring("wide", 1, 8)), 16, -10).cast("long"))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``id, root`` for ids that have a near copy; ``root`` is the least id of their class.

    Links are pairs whose sets of ``width``-word shingles have at least the given
    Jaccard similarity. Rows without an id link with nothing.
    """
    kind = T.StructType().add("wide", T.BinaryType()).add("bands", T.ArrayType(T.LongType()))
    with_set = T.StructType().add("wide", T.BinaryType()).add("shingles", T.ArrayType(T.LongType()))

    @F.pandas_udf(kind)
    def marks(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        return pd.DataFrame({"wide": [wide_fingerprint(x) for x in sets], "bands": [band_keys(x) for x in sets]})

    @F.pandas_udf(with_set)
    def sets(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(t, width) for t in texts]
        return pd.DataFrame({"wide": [wide_fingerprint(x) for x in found], "shingles": [np.sort(x.view(np.int64)) for x in found]})

    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    marked = cut(rows.select("key", marks("text").alias("m")).select("key", "m.*"))
    banded = _wide_rows(marked).select("key", "wide", "turned", F.posexplode("bands").alias("k", "head"))
    shared = banded.groupBy("k", "head").count().where("count > 1").select("k", "head")
    nodes = cut(_node_pairs(banded.join(shared, ["k", "head"]).withColumn("depth", F.lit(0))))
    loose = components(_deal(nodes, nodes.count(), _spanning(WORD_BUDGET, WIDE_BUDGET)))

    members = loose.select(F.col("id").alias("key"), F.col("root").alias("head")).join(rows, "key")
    known = _wide_rows(members.select("key", "head", sets("text").alias("m")).select("key", "head", "m.*"))
    known = cut(known.withColumn("k", F.lit(0)).withColumn("depth", F.lit(0)))
    weight = F.greatest(F.size("shingles"), F.lit(SET_LEAST)).cast("long")
    exact = _spanning(WORD_BUDGET, WIDE_BUDGET, similarity)
    pieces = _node_pairs(known, NODE_SHINGLES, weight)
    return components(_deal(pieces, pieces.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0], exact, TASK_SHINGLES))


def drop_similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one document of each class of near copies, the one of the smallest id, and all that have no id."""
    if not docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        # a number for each row, written down so that it stays; rows of smaller ids come first only within a partition
        rows = cut(docs.withColumn("_row", F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())))
        return drop_similar(rows, "_row", text_col, width, similarity).select(*docs.columns)
    near = similar_documents(docs, id_col, text_col, width, similarity)
    gone = near.where("id <> root").select(F.col("id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
