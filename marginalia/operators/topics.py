"""Topics: deterministic spherical k-means over live vectors, and its report.

Points stay in the table. A round sends the centres, k of them and at most twenty by
default, to the scan; there a matrix product in Arrow batches assigns the points, and
each task adds up one vector per cluster before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text
from marginalia.functions.vectors import as_doubles

ITERATIONS, EXAMPLES, LOOSE, STILL = 25, 3, 0.45, 1e-12
#: Parts of a cluster whose nearest members are found first.
SALTS = 64


def default_count(n: int) -> int:
    if n < 4:
        return 0 if n < 2 else 2
    return min(max(math.floor(math.sqrt(n / 2) + 0.5), 2), 20)


def matrix(values: pa.Array) -> np.ndarray:
    """An array of equally long lists as rows."""
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def nearest(centres: list[list[float]]):
    """A UDF: ``cluster, similarity`` of the centre most like a vector, ties to the first."""
    c = np.array(centres, np.float64).T

    @F.pandas_udf(T.StructType().add("cluster", T.IntegerType()).add("similarity", T.DoubleType()))
    def of(vectors: pd.Series) -> pd.DataFrame:
        scores = np.stack(vectors.to_numpy()) @ c if len(vectors) else np.zeros((0, c.shape[1]))
        at = scores.argmax(axis=1)
        return pd.DataFrame({"cluster": at.astype(np.int32), "similarity": scores[np.arange(len(at)), at]})

    return of


def seed(points: DataFrame, k: int) -> list[list[float]]:
    """Furthest first: the first point, then each time the one least like any chosen; ties to the first.

    ``points(segment, slot, _v)``. Fewer centres where a point would be chosen twice.
    """
    first = points.orderBy("segment", "slot").first()
    chosen, seen = [list(first["_v"])], {(first["segment"], first["slot"])}
    while len(chosen) < k:
        near = points.select("segment", "slot", "_v", nearest(chosen)("_v").alias("n"))
        far = near.orderBy("n.similarity", "segment", "slot").first()
        if (far["segment"], far["slot"]) in seen:
            break
        seen.add((far["segment"], far["slot"]))
        chosen.append(list(far["_v"]))
    return chosen


def assign(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``cluster, similarity``: the nearest centre, ties to the first."""
    return points.withColumn("_best", nearest(centres)("_v")).select(*points.columns, "_best.cluster", "_best.similarity")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's points added up: a row per cluster."""
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        v, cluster = matrix(batch["_v"]), batch["cluster"].to_numpy()
        for c in np.unique(cluster).tolist():
            rows = v[cluster == c]
            n, held = totals.get(c, (0, 0.0))
            totals[c] = (n + len(rows), held + rows.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(totals, pa.int32()), pa.array([n for n, _ in totals.values()], pa.int64()), pa.array([list(x) for _, x in totals.values()], pa.list_(pa.float64()))],
        ["cluster", "n", "sums"],
    )


def centroids(assigned: DataFrame) -> DataFrame:
    """``cluster, n, sums``: sums per axis, added up in each task before the shuffle."""
    parts = assigned.select(F.col("cluster").cast("int").alias("cluster"), "_v").mapInArrow(_sums, "cluster int, n long, sums array<double>")
    axes = parts.select("cluster", "n", F.posexplode("sums").alias("axis", "x"))
    sums = axes.groupBy("cluster", "axis").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    row = F.array_sort(F.collect_list(F.struct("axis", "x")))
    return sums.groupBy("cluster").agg(F.max("n").alias("n"), row.alias("r")).select("cluster", "n", F.col("r.x").alias("sums"))


def fit(vectors: DataFrame, k: int | None = None, iterations: int = ITERATIONS) -> list[list[float]]:
    """Centres of ``vectors(segment, slot, vector)``; an empty cluster keeps its centre."""
    points = vectors.select("segment", "slot", as_doubles(F.col("vector")).alias("_v")).persist()
    try:
        n = points.count()
        k = min(k or default_count(n), n)
        if k < 2:
            return []
        centres = np.array(seed(points, k))
        for _ in range(iterations):
            moved = centres.copy()
            for row in centroids(assign(points, centres.tolist())).collect():  # k rows
                sums = np.array(row["sums"])
                length = float(np.linalg.norm(sums))
                if length > 0:
                    moved[row["cluster"]] = sums / length
            still, centres = np.allclose(moved, centres, rtol=0, atol=STILL), moved
            if still:  # nothing has changed its cluster: only the order of additions may differ
                break
        return centres.tolist()
    finally:
        points.unpersist()


def topic_map(vectors: DataFrame, centres: list[list[float]], examples: int = EXAMPLES) -> DataFrame:
    """One row per cluster: ``cluster, chunks, notes, cohesion, loose, examples``.

    ``vectors`` also has ``object`` and ``start``; examples are the nearest, then by object and start.
    """
    points = vectors.withColumn("_v", as_doubles(F.col("vector"))).drop("vector")
    placed = assign(points, centres)
    rolled = placed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("object").alias("notes"), F.avg("similarity").alias("cohesion")
    )
    # the best of each part of a cluster first, so that no cluster is sorted as a whole
    best = lambda rows, *by: rows.withColumn("_rk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), "object", "start"))).where(F.col("_rk") <= examples)
    dealt = placed.select("cluster", "object", "start", "similarity").withColumn("_salt", F.pmod(F.xxhash64("object", "start"), F.lit(SALTS)))
    nearest_few = best(best(dealt, "cluster", "_salt").drop("_rk"), "cluster")
    shown = nearest_few.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(F.col("_rk").alias("rk"), "object", "start", "similarity"))).alias("examples"))
    return rolled.join(shown, "cluster").withColumn("loose", F.col("cohesion") < LOOSE)


#: Fixed: what a model is asked for, and what stands between two excerpts.
QUESTION = "Name the common subject of these excerpts in two to five words. Reply with the name alone, no punctuation, no preamble."
BETWEEN = "\n---\n"


def labelled(topics: DataFrame, passages: DataFrame, generate: Callable[[Column, Column], Column]) -> DataFrame:
    """``topics`` with ``label``: what ``generate(question, excerpts)`` replies to the texts of the examples, cleaned up.

    ``passages(object, start, text)``. ``generate`` makes a column of replies of two columns, so
    it may be an expression or a UDF that asks a model, once a topic. The label is null where no
    example has a text, or the reply is null or nothing but marks.
    """
    each = topics.select("cluster", F.explode("examples").alias("e")).select("cluster", "e.rk", "e.object", "e.start")
    texts = each.join(passages.select("object", "start", "text").where("text <> ''"), ["object", "start"])
    excerpts = F.array_join(F.array_sort(F.collect_list(F.struct("rk", F.concat("text", F.lit(BETWEEN)).alias("t")))).getField("t"), "")
    prompts = texts.groupBy("cluster").agg(excerpts.alias("excerpts"))
    reply = generate(F.lit(QUESTION), F.col("excerpts"))
    named = prompts.select("cluster", F.nullif(text.label(reply), F.lit("")).alias("label"))
    return topics.join(named, "cluster", "left")


def in_order(topics: DataFrame) -> DataFrame:
    return topics.orderBy(F.desc("chunks"), F.desc("cohesion"), "cluster")
