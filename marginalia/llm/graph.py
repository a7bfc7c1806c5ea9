"""Connected components of a link table, by alternating large-star and small-star steps.

Links stay a distributed table throughout; only counts reach the driver. Each
round ends in a checkpoint in the shared folder, so lineage stays short and a
lost executor costs a re-read. Minima are aggregated before the shuffle; the
joins that hand them back are salted, so the links of a hub spread over tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut


#: Places that the links of one vertex are dealt to.
SALTS = 16


def _downward(links: DataFrame) -> DataFrame:
    """Each link once, from the larger end ``a`` to the smaller ``b``."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ordered.where(F.col("a") != F.col("b")).distinct()


def with_value(rows: DataFrame, values: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` joined to the one row of ``values`` for their ``key``: that is sent to SALTS places, each of ``rows`` to one by ``spread``."""
    salted = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` joined to ``least(a, m)``."""
    return with_value(links, least, "a", "b")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _downward(_with_least(both, least).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(links, least).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _downward(moved.union(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``id, root``: the smallest id reachable, for every id with a link.

    Null ends and links of an id with itself are left out; repeated links count
    once. No links give an empty table.
    """
    now = cut(_downward(links.where("a IS NOT NULL AND b IS NOT NULL")))
    mark = _mark(now)
    while mark[0]:
        now = cut(_small_star(_large_star(now)))
        seen, mark = mark, _mark(now)
        if seen == mark:
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)


def _mark(links: DataFrame) -> tuple:
    """A count and an order-free checksum, by which a round that changes nothing is seen."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of ``i`` and ``j`` in ``label``, which maps each index to the least of its class."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further
