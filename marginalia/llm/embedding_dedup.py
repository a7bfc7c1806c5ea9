"""Embedding near-dedup by a PCA-ordered tiled comparison.

Vectors are made unit length and turned to principal axes, widest first. A pair
is compared a block of axes at a time: the product so far plus the product of the
two remaining norms bounds the cosine, and a pair whose bound is under the
threshold is dropped. What survives is settled by the cosine of the original
vectors in double precision, so neither the axes nor the tiles change a result.

Equal vectors of a label are one vector with a weight: they are found by a 128-bit
hash on narrow rows, and only one of them is compared, so thousands of copies cost
as much as one. Tiles hold about ``TILE`` vectors of one label. They are cells of a
grid over the first two axes, at quantiles of the vectors themselves: two unit
vectors within the threshold are close in that plane, so only tiles come together
whose ranges are. A cell with too many vectors is dealt into several tiles by a hash.
A task compares two tiles; it returns counts per vector and links that span what it
connected, so its output is as long as its tiles and never as long as the pairs it found.

Defined results
    null, zero or not finite  a vector with such values links with nothing; the
                              same for a null label and for vectors of another width
    repeated rows             each row stays, and links with its copies
    repeated ids              each vector is compared for itself: rows of an id have the links
                              and the component of their own vector
    null id                   links with nothing
    empty table               an empty result
    other columns             not kept
    labels                    of any type; those that are not whole numbers are compared by hash
The axes are fitted on ``SAMPLE`` vectors in expectation; that affects speed only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.graph import components, union, with_value
from marginalia.session import chosen, cut, numbered

TILE, SAMPLE, SLICES, AXES = 1024, 4096, 4096, 16
#: Places that the tiles of one stretch of the first axis are dealt to where tiles meet.
SALTS = 16
SLACK = 1e-9


def usable() -> Column:
    """Whether a row can link."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    return F.coalesce(good & fine & some, F.lit(False))


def principal_axes(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each width an orthogonal matrix whose columns are axes, from a sample of bounded size."""
    sample = rows.where(chosen(F.xxhash64("id", F.lit("axes")), SAMPLE, n)).select("dim", "embedding").limit(2 * SAMPLE)
    axes = {}
    got = sample.toPandas()
    for dim, part in got.groupby("dim"):
        x = units(np.array(part["embedding"].tolist(), np.float64))
        axes[int(dim)] = np.linalg.eigh(np.cov(x, rowvar=False).reshape(dim, dim))[1][:, ::-1] if len(x) > 1 else np.eye(int(dim))
    return axes


def units(x: np.ndarray) -> np.ndarray:
    """Rows to unit length; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def close_pairs(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` (units) with a cosine of at least ``threshold``.

    ``ra`` and ``rb`` are the same rows on principal axes.
    """
    dim = ra.shape[1]
    edges = [*range(0, dim, AXES), dim]
    rest = lambda r, k: np.sqrt(np.maximum((r[:, k:] ** 2).sum(axis=1), 0.0))
    least, i, j, so_far = threshold - SLACK, None, None, np.zeros((len(ra), len(rb)))
    for lo, hi in zip(edges, edges[1:]):
        left, right = rest(ra, hi), rest(rb, hi)
        if i is None:
            so_far += ra[:, lo:hi] @ rb[:, lo:hi].T
            alive = so_far + left[:, None] * right[None, :] >= least
            if alive.mean() < 0.2 or hi == dim:
                i, j = np.nonzero(alive)
                so_far = so_far[i, j]
        else:
            so_far = so_far + np.einsum("ij,ij->i", ra[i, lo:hi], rb[j, lo:hi])
            alive = so_far + left[i] * right[j] >= least
            i, j, so_far = i[alive], j[alive], so_far[alive]
        if i is not None and not len(i):
            return i, j
    exact = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) for k in range(0, len(i), 65536)])
    return i[exact >= threshold], j[exact >= threshold]


def _compare(threshold: float, axes: dict[int, np.ndarray]):
    def task(pair: pd.DataFrame) -> pd.DataFrame:
        ids, side, weight = pair["id"].to_numpy(), pair["side"].to_numpy(), pair["n"].to_numpy()
        x = units(np.array(pair["embedding"].tolist(), np.float64))
        r = x @ axes[x.shape[1]] if x.shape[1] in axes else x
        own = not side.any()
        a = np.flatnonzero(side == 0)
        b = a if own else np.flatnonzero(side == 1)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(a), 256):
            rows = a[at : at + 256]
            i, j = close_pairs(x[rows], x[b], r[rows], r[b], threshold)
            i, j = rows[i], b[j]
            i, j = i[i != j], j[i != j]
            np.add.at(links, i, weight[j])
            if not own:
                np.add.at(links, j, weight[i])
            union(label, i, j)
        on = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[on], "links": links[on], "other": ids[label[on]]})

    return task


def _quantiles(rows: DataFrame, keys: list[str], lead: str, name: str, size: Column) -> DataFrame:
    """``rows`` with ``name``: slices of about ``size`` rows of each key along ``lead``. ``size`` is a column of ``rows``."""
    fine = F.floor((F.col(lead) + 1) / 2 * SLICES)
    counts = rows.groupBy(*keys, fine.alias("fine")).agg(F.count(F.lit(1)).alias("count"), F.first(size).alias("size"))
    w = Window.partitionBy(*keys).orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.select(*keys, "fine", F.floor(F.coalesce(F.sum("count").over(w), F.lit(0)) / F.col("size")).alias(name))
    return rows.withColumn("fine", fine).join(slices, [*keys, "fine"]).drop("fine")


def _meeting(tiles: DataFrame, reach: float) -> DataFrame:
    """``tile, tile_b, pair`` of the tiles that may hold two vectors within ``reach``, each pair once.

    Tiles are placed in the stretches of the first axis that they touch, the second
    side with the reach added; of the stretches that two share the first counts.
    """
    wide = max(reach, 1 / 64)
    at = lambda c: F.floor(c / wide)
    own = tiles.withColumn("cell", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi"))))).withColumn("salt", F.pmod("tile", F.lit(SALTS)))
    other = tiles.select("label", "dim", *[F.col(c).alias(f"{c}_b") for c in ("tile", "lo", "hi", "lo2", "hi2", "slice", "sub", "part")])
    other = other.withColumn("cell", F.explode(F.sequence(at(F.col("lo_b") - reach), at(F.col("hi_b") + reach))))
    other = other.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    apart = lambda lo, hi: F.greatest(F.col(f"{lo}_b") - F.col(hi), F.col(lo) - F.col(f"{hi}_b"), F.lit(0.0))
    first = F.greatest(at(F.col("lo")), at(F.col("lo_b") - reach))
    return (
        own.join(other, ["label", "dim", "cell", "salt"])
        .where((F.struct("slice", "sub", "part") <= F.struct("slice_b", "sub_b", "part_b")) & (F.col("cell") == first))
        .where(F.pow(apart("lo", "hi"), 2) + F.pow(apart("lo2", "hi2"), 2) <= reach * reach)
        .select("tile", "tile_b", F.xxhash64("tile", "tile_b").alias("pair"))
    )


def _tiled(rows: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """Rows once for each pair of tiles they meet in: ``pair, side, id, n, embedding``."""

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plane = np.zeros((len(batch), 2))
            for dim, at in batch.groupby("dim").indices.items():
                x = units(np.array(batch["embedding"].iloc[at].tolist(), np.float64))
                turned = x @ axes[dim][:, :2] if dim in axes else x[:, :2]
                plane[at, : turned.shape[1]] = turned
            yield batch.assign(lead=plane[:, 0], lead2=plane[:, 1])

    columns = "id long, n long, label long, dim int, embedding array<double>, lead double, lead2 double"
    led = cut(rows.select("id", "n", "label", "dim", "embedding").mapInPandas(leading, columns))
    # a label of n vectors has n / TILE tiles: as many slices along the first axis as each has along the second
    totals = led.groupBy("label", "dim").agg((F.ceil(F.sqrt(F.ceil(F.count(F.lit(1)) / TILE))) * TILE).alias("wide"))
    sliced = _quantiles(led.join(totals, ["label", "dim"]), ["label", "dim"], "lead", "slice", F.col("wide")).drop("wide")
    sliced = _quantiles(sliced, ["label", "dim", "slice"], "lead2", "sub", F.lit(TILE))
    place = ["label", "dim", "slice", "sub"]
    ends = [f(c).alias(n) for c, lo, hi in (("lead", "lo", "hi"), ("lead2", "lo2", "hi2")) for f, n in ((F.min, lo), (F.max, hi))]
    full = sliced.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"), *ends)
    tiles = full.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("tile", F.xxhash64(*place, "part"))
    meets = _meeting(tiles, math.sqrt(max(2 - 2 * threshold, 0.0)) + SLACK)
    sides = meets.select("tile", "pair", F.lit(0).cast("byte").alias("side")).union(
        meets.where("tile <> tile_b").select("tile_b", "pair", F.lit(1).cast("byte"))
    )
    placed = sliced.join(full.select(*place, "parts"), place).withColumn("tile", F.xxhash64(*place, F.pmod(F.xxhash64("id"), F.col("parts"))))
    return placed.select("tile", "id", "n", "embedding").join(sides, "tile").select("pair", "side", "id", "n", "embedding")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept`` under the name of ``id_col``."""
    whole = dict(vectors.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint")
    label = F.col(label_col).cast("long") if whole else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64("embedding", F.lit("second")))
    same = ["label", "h1", "h2"]
    marked = cut(rows.select("id", *same, usable().alias("good")))
    groups = marked.where("good").groupBy(*same).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = cut(numbered(groups, ["h1", "h2", "label"], "group"))
    firsts = rows.join(groups.withColumnRenamed("least", "id"), [*same, "id"]).dropDuplicates(["group"])
    good = firsts.select(F.col("group").alias("id"), "n", "label", F.size("embedding").alias("dim"), "embedding")
    axes = principal_axes(good, groups.count())
    found = cut(_tiled(good, axes, threshold).groupBy("pair").applyInPandas(_compare(threshold, axes), "id long, links long, other long"))
    roots = components(found.select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "group")
    counts = found.groupBy(F.col("id").alias("group")).agg(F.sum("links").alias("links"))
    # a row for each group of equal vectors: what it links to, and the least id that it reaches
    linked = cut(groups.join(counts, "group", "left").join(roots, "group", "left").select(
        *same, "group", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "group").alias("root")
    ))
    component = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    told = cut(with_value(linked, component, "root", "group").select(*same, "n_links", "component_id", F.lit(True).alias("good")))
    reached = F.coalesce("component_id", "id")
    return marked.join(told, [*same, "good"], "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        reached.alias("component_id"),
        reached.eqNullSafe(F.col("id")).alias("kept"),
    )
