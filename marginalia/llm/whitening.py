"""Embedding whitening by the singular values of centred distributed rows.

Entries become whole numbers, ``floor(scale * c)``, so that counts, sums and deviations are
exact. The fit list is each distinct vector once; it is written out centred, and the
singular value decomposition of MLlib runs over its rows: the right singular vectors are the
components, and a singular value squared over n is the variance along one. The total
variance comes from the exact deviations and not from the decomposition.

Only sums per dimension, the decomposition and a small matrix of products reach the driver:
their size is the width of the vectors, whatever the number of rows.

Defined results
    null vectors          and those with null or not finite entries, or entries whose scaled value is no long: left out
    other widths          the width that most rows have is fitted (of equals the smaller); rows of others are left out
    repeated vectors      one place in the fit list; each row has its result
    null ids, repeated ids and rows   each row has its result
    no variance           components whose variance is below ``RANK`` of the first's are noise and left out: one
                          distinct vector, or none, gives no rows
    equal variances       any basis of what they span
    deviations            decimals of 38 digits
    other columns         not kept
    empty table           an empty result
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut

SCALE = 256
#: Share of the first component's variance under which another is rounding noise.
RANK = 1e-12
#: Widest vectors whose whole spectrum is computed, which is dense and exact to rounding; MLlib doesn't do more in one place.
DENSE = 15_000


@dataclass
class Whitener:
    """What a fit gives: ``n`` and ``sums`` are exact, the rest is double."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total_variance: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _usable(v: Column) -> Column:
    """Whether all entries are finite, and longs once they are scaled."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < F.lit(float(1 << 63)))
    return F.coalesce(v.isNotNull() & F.forall(v, fits), F.lit(False))


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x`` of the usable rows of the most frequent width, ``x`` an array of longs."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(_usable(v))
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    of_width = rows.where(F.size("v") == F.lit(width.width if width else 0))
    return of_width.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def _off_centre(x: Column, n: int, sums: list[int]) -> Column:
    """n * x - S, exact."""
    wide = lambda c: c.cast("decimal(38,0)")
    totals = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums]) if sums else F.array().cast("array<decimal(38,0)>")
    return F.zip_with(x, totals, lambda a, s: wide(wide(a) * F.lit(n)) - s)


def deviation(off_centre: Column) -> Column:
    """The sum of squares of whole numbers, exact."""
    square = lambda d: (d * d).cast("decimal(38,0)")
    return F.aggregate(off_centre, F.lit(0).cast("decimal(38,0)"), lambda total, d: (total + square(d.cast("decimal(38,0)"))).cast("decimal(38,0)"))


def _projected(rows: DataFrame, x: str, fit: Whitener, columns: list[str]) -> DataFrame:
    """``rows`` with ``w``: x less the mean, on each component, over the root of its variance."""
    mean, onto = fit.mean, fit.components / np.sqrt(fit.variances)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = (np.array(batch[x].tolist(), np.float64).reshape(len(batch), len(mean)) - mean) @ onto
            yield batch[columns].assign(w=list(w))

    kinds = dict(rows.dtypes)
    return rows.select(*dict.fromkeys([*columns, x])).mapInPandas(project, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + (", " if columns else "") + "w array<double>")


def fit(x_rows: DataFrame, k: int) -> tuple[Whitener | None, DataFrame]:
    """A whitener of up to ``k`` components, and the fit list it was learnt from; None where there are no rows."""
    distinct = cut(x_rows.select("x").distinct())
    n = distinct.count()
    by_place = distinct.select(F.posexplode("x").alias("place", "c")).groupBy("place").agg(F.sum(F.col("c").cast("decimal(28,0)")).alias("s"))
    # a row for each dimension
    sums = [int(r.s) for r in by_place.orderBy("place").collect()]
    if not n or not sums:
        return None, distinct
    centred = cut(distinct.select("x", _off_centre(F.col("x"), n, sums).alias("d")).select("x", deviation(F.col("d")).alias("deviation"), F.transform("d", lambda d: d.cast("double") / n).alias("c")))
    exact = int(centred.agg(F.sum("deviation")).first()[0])
    if not exact:
        return None, distinct
    dim = len(sums)
    rows = RowMatrix(MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("c").alias("c"))), n, dim)
    svd = rows.computeSVD(dim if dim <= DENSE else min(k, dim), computeU=False, rCond=RANK**0.5)
    singular = np.array(svd.s.toArray())[:k]
    components = np.array(svd.V.toArray())[:, : len(singular)]
    return Whitener(n, sums, components, singular**2 / n, exact / n**3), distinct


def identity_error(fit_list: DataFrame, fitted: Whitener) -> float:
    """The largest entry, in absolute value, of the whitened fit list's covariance less the identity."""
    k = len(fitted.variances)
    w = _projected(fit_list, "x", fitted, [])
    mean = w.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    off = lambda i: F.col("w")[i] - F.lit(float(mean[i]))
    products = w.agg(*[F.avg(off(i) * off(j)).alias(f"p{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    return max(abs(products[f"p{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))


def whiten(vectors: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    rows = cut(whole_numbers(vectors, id_col, vector_col))
    fitted, fit_list = fit(rows, k)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if fitted is None:
        kinds = ["int", "long", "decimal(38,0)", "double", "double", "double"]
        return rows.limit(0).select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in zip(names[1:], kinds)])
    error = identity_error(fit_list, fitted)
    told = rows.withColumn("deviation", deviation(_off_centre(F.col("x"), fitted.n, fitted.sums)))
    each = _projected(told, "x", fitted, ["id", "deviation"]).select("id", "deviation", F.posexplode("w").alias("place", "whitened"))
    shares = F.array(*[F.lit(float(e / fitted.total_variance)) for e in fitted.variances])
    return each.select(
        F.col("id").alias(id_col),
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
