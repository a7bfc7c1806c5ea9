"""Exact similarity search: score, rank under a total order, merge, and the score floors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marginalia.functions.vectors import as_doubles

#: Vectors of a group, and questions where only the best of a group go on and where any pair may: what one task holds at a time.
CHUNK, QUERY_BLOCK, PAIR_BLOCK = 8192, 4096, 512
#: Questions scored at a time, and vectors and questions of a tile that stays in the processor's cache.
ASKED, TILE, TILE_ASKED = 256, 1024, 32
#: Single pairs that are added up at a time.
PAIRS = 65536
#: Where any pair may go on: questions that travel to all tasks together, vectors of a task at the least, and pairs that a task looks at together, without and with a floor.
TOLD, SHARE, HELD, HELD_ABOVE = 8192, 1024, 1 << 20, 1 << 23


def _matrices(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``places, rows, holes`` of the vectors of each width; a hole is a vector with a null entry."""
    lists = column.combine_chunks()
    widths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    for w in np.unique(widths[widths >= 0]).tolist():
        at = np.flatnonzero(widths == w)
        flat = lists.take(pa.array(at)).flatten()
        holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), w).any(axis=1)
        yield at, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), w), holes


def _dots(asked: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``asked`` and the columns of ``axes``, added up dimension by dimension as SQL does."""
    out = np.zeros((len(asked), axes.shape[1]))
    product = np.empty((TILE_ASKED, TILE))
    for a in range(0, len(asked), TILE_ASKED):
        some = np.ascontiguousarray(asked[a : a + TILE_ASKED].T)[:, :, None]
        for b in range(0, axes.shape[1], TILE):
            part = np.zeros(out[a : a + TILE_ASKED, b : b + TILE].shape)
            held = product[: part.shape[0], : part.shape[1]] if part.shape[1] == TILE else np.empty(part.shape)
            for j in range(len(axes)):
                np.multiply(some[j], axes[j, b : b + TILE], out=held)
                np.add(part, held, out=part)
            out[a : a + TILE_ASKED, b : b + TILE] = part
    return out


def _pairs(asked: np.ndarray, axes: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """What :func:`_dots` gives for the pairs ``rows, cols`` alone."""
    out, across = np.zeros(len(rows)), np.ascontiguousarray(asked.T)
    for k in range(0, len(rows), PAIRS):
        r, c = rows[k : k + PAIRS], cols[k : k + PAIRS]
        for j in range(len(axes)):
            out[k : k + PAIRS] += across[j][r] * axes[j][c]
    return out


def _slack(asked: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """How far, for each row of ``asked``, sums of its products in any two orders can be apart; not finite where a sum may not be."""
    with np.errstate(all="ignore"):
        lengths = [np.sqrt((x * x).sum(axis=1 - along)) for x, along in ((asked, 0), (axes, 1))]
        return 4 * (len(axes) + 4) * np.finfo(np.float64).eps * lengths[0] * lengths[1].max(initial=0.0) + 1e-290


def _near(asked: np.ndarray, axes: np.ndarray, slack: np.ndarray, edges: list[int], k: int | None, least: np.ndarray | None, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rows, cols, scores`` of the first ``k`` of each row between two ``edges``, of what is not below ``least``.

    A matrix product says what can be among them, rounding included; those pairs alone are
    added up in SQL's order, and that sum decides.
    """
    rough, slack = asked @ axes, slack[:, None]
    keep = ~gone
    if least is not None:
        keep &= ~(rough < least[:, None] - slack)
    if k is not None:
        rough[~keep] = -np.inf
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo > k:
                part = rough[:, lo:hi]
                keep[:, lo:hi] &= part >= np.partition(part, hi - lo - k, axis=1)[:, hi - lo - k, None] - 2 * slack
    rows, cols = np.nonzero(keep)
    scores = _pairs(asked, axes, rows, cols)
    if least is not None:
        some = ~(scores < least[rows])
        rows, cols, scores = rows[some], cols[some], scores[some]
    if k is not None:
        run = rows * len(edges) + np.searchsorted(edges, cols, side="right")
        order = np.lexsort((cols, -scores, run))
        starts = np.flatnonzero(np.r_[True, run[order][1:] != run[order][:-1]]) if len(order) else order
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        some = np.sort(order[place < k])
        rows, cols, scores = rows[some], cols[some], scores[some]
    return rows, cols, scores


def _best(scores: np.ndarray, last: np.ndarray, gone: np.ndarray, k: int) -> np.ndarray:
    """Which of each row are its first ``k``: not a number first, then by score; nulls (``last``) at the end; of equals the first; none that is ``gone``."""
    if scores.shape[1] <= k:
        return ~gone
    key = np.where(np.isnan(scores), np.inf, scores)
    key[last | gone] = -np.inf
    kth = -np.partition(-key, k - 1, axis=1)[:, k - 1 : k]
    keep = key >= kth
    for i in np.flatnonzero((keep.sum(axis=1) > k) | ~np.isfinite(kth[:, 0])).tolist():
        kind = np.where(gone[i], 3, np.where(last[i], 2, np.where(np.isnan(scores[i]), 0, 1)))
        keep[i] = False
        keep[i, np.lexsort((-np.where(kind == 1, scores[i], 0.0), kind))[:k]] = True
    return keep & ~gone


def scored(vectors: DataFrame, queries: DataFrame, best: int | None = None, per_segment: bool = False, apart: bool = False) -> DataFrame:
    """``q, score`` and the columns of ``vectors(segment, slot, vector)`` for pairs of a stated query set and all live vectors.

    With ``best`` vectors and questions meet in groups of a chunk of the one and a block of the
    other, so no task holds more than a group. A group gives its first so many of each
    question, or of each question and segment, alone: all that the first so many of the whole
    can be among. Which those are a matrix product tells first (:func:`_near`). Without it
    vectors stay in their tasks and blocks of questions come to them (:func:`_told`). Where
    ``queries`` has ``least``, what scores below it is left out. ``apart`` leaves out pairs of
    a question and the slot with its id.
    """
    block = TOLD if best is None else QUERY_BLOCK if not per_segment else min(QUERY_BLOCK, PAIR_BLOCK)
    chunks, blocks = (max(-(-rows.count() // most), 1) for rows, most in ((vectors, CHUNK), (queries, block)))
    exact = lambda rows, c: F.col(c) if dict(rows.dtypes)[c] in ("array<float>", "array<double>") else as_doubles(F.col(c))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, *key: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    floor = ["least"] if "least" in queries.columns else []
    kept = [c for c in vectors.columns if c != "vector"]
    key = ["_chunk", "_block"]
    held = vectors.select(*kept, exact(vectors, "vector").alias("_v"))
    asked = queries.select("q", exact(queries, "qv").alias("_qv"), *floor, place(blocks, "q").alias("_block"))
    fields = [vectors.schema[c] for c in kept] + [queries.schema["q"], StructField("score", DoubleType())]
    names = [f.name for f in fields]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        order = pc.sort_indices(left.select(["segment", "slot"]), sort_keys=[("segment", "ascending"), ("slot", "ascending")], null_placement="at_start")
        left = left.take(order)
        n, found = left.num_rows, []
        sides = {v.shape[1]: (at, np.ascontiguousarray(v.T), holes) for at, v, holes in _matrices(left["_v"])}
        wanted = [(at, v, holes) for at, v, holes in _matrices(right["_qv"]) if v.shape[1] in sides]
        edges = [0, n]
        if per_segment:
            runs = left["segment"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            edges = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), n]
        slots, ids = (np.array(t[c].to_pylist(), dtype=object) for t, c in ((left, "slot"), (right, "q"))) if apart else (None, None)
        least = right["least"].to_numpy().astype(np.float64) if floor else None
        # one width and no holes: what can't be among the first needs no sum in SQL's order
        slack = None
        if (best is not None or floor) and n and len(wanted) == 1 and len(wanted[0][0]) == right.num_rows and not wanted[0][2].any():
            cols, axes, missing = sides[wanted[0][1].shape[1]]
            if len(cols) == n and not missing.any():
                slack = _slack(wanted[0][1], axes)
                slack = slack if np.isfinite(slack).all() else None
        for a in range(0, right.num_rows, ASKED):
            size = min(ASKED, right.num_rows - a)
            if slack is not None:
                some = slice(a, a + size)
                gone = slots[None, :] == ids[some, None] if apart else np.zeros((size, n), bool)
                rows, cols, values = _near(wanted[0][1][some], axes, slack[some], edges, best, least[some] if floor else None, gone)
                found.append((rows + a, cols, values, np.zeros(len(rows), bool)))
                continue
            scores, last, gone = np.zeros((size, n)), np.zeros((size, n), bool), np.zeros((size, n), bool)
            for at, v, holes in wanted:
                some = (at >= a) & (at < a + size)
                cols, axes, missing = sides[v.shape[1]]
                with np.errstate(all="ignore"):
                    scores[np.ix_(at[some] - a, cols)] = _dots(v[some], axes)
                if missing.any() or holes.any():
                    last[np.ix_(at[some] - a, cols)] = missing[None, :] | holes[some][:, None]
            if apart:
                gone |= slots[None, :] == ids[a : a + size, None]
            if floor:
                gone |= scores < least[a : a + size, None]
            keep = ~gone
            if best is not None:
                for lo, hi in zip(edges, edges[1:]):
                    keep[:, lo:hi] = _best(scores[:, lo:hi], last[:, lo:hi], gone[:, lo:hi], best)
            rows, cols = np.nonzero(keep)
            found.append((rows + a, cols, scores[rows, cols], last[rows, cols]))
        rows, cols, values, missing = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        out = left.select(kept).take(pa.array(cols))
        out = out.append_column("q", right["q"].take(pa.array(rows))).append_column("score", pa.array(values.astype(np.float64), mask=missing.astype(bool)))
        return out.select(names)

    if best is None:
        tasks = held.repartition(min(-(-chunks * CHUNK // SHARE), 4096), "segment", "slot")
        told = [_told(tasks, asked.where(F.col("_block") == b).drop("_block"), meet, StructType(fields), HELD_ABOVE if floor else HELD) for b in range(blocks)]
        return reduce(DataFrame.unionByName, told)
    held = held.select("*", place(chunks, "segment", "slot").alias("_chunk"), spread(blocks).alias("_block"))
    asked = asked.select("*", spread(chunks).alias("_chunk"))
    # as many partitions as groups, that no few tasks get them all
    parts = min(chunks * blocks, 4096)
    dealt = lambda rows: rows.repartition(parts, *key).groupBy(*key)
    return dealt(held).cogroup(dealt(asked)).applyInArrow(meet, StructType(fields))


def _told(held: DataFrame, asked: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType, most: int) -> DataFrame:
    """What ``meet`` gives for all pairs of ``held`` and ``asked``, about ``most`` pairs at a time.

    ``asked`` is sent to the tasks and ``held`` to none, so nothing is shuffled for a pair.
    """
    questions = held.sparkSession.sparkContext.broadcast(asked.toArrow())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(left: pa.Table) -> Iterator[pa.RecordBatch]:
            step = max(most // left.num_rows, 1)
            for a in range(0, questions.value.num_rows, step):
                yield from meet(left, questions.value.slice(a, step)).combine_chunks().to_batches()

        some: list[pa.RecordBatch] = []
        for batch in batches:
            some.append(batch)
            if sum(b.num_rows for b in some) >= CHUNK:
                yield from met(pa.Table.from_batches(some))
                some = []
        if sum(b.num_rows for b in some):
            yield from met(pa.Table.from_batches(some))

    return held.mapInArrow(task, schema)


def nearer(*partition: str) -> Window:
    """Score descending, then segment and slot: the same order on any partitioning."""
    return Window.partitionBy(*partition).orderBy(F.desc("score"), "segment", "slot")


def topk(scores: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query with their rank ``rk``."""
    return scores.withColumn("rk", F.row_number().over(nearer("q"))).where(F.col("rk") <= k)


def topk_per_segment(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("rk", F.row_number().over(nearer("q", "segment"))).where(F.col("rk") <= k)


def topk_merged(scores: DataFrame, k: int) -> DataFrame:
    """Best of each segment first, then the best of those: equal to :func:`topk`."""
    return topk(topk_per_segment(scores, k).drop("rk"), k)


def rounded(score: Column) -> Column:
    """``F.round(score, 6)``; decimals are asked only where a score lies about halfway, as they cost most of a row."""
    scaled = score * 1e6
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < 1e9) & (F.abs(F.abs(scaled - whole) - 0.5) > 1e-4)
    return F.when(plain, whole / 1e6 + 0.0).otherwise(F.round(score, 6))
