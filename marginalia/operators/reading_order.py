"""The reading order of documents of any length: an Euler tour of the character tree, ranked by pointer doubling.

A character hangs on the left or the right of another; what hangs on its left is read
before it, what hangs on its right after it, siblings by (counter, replica). Characters
that were typed one after the other, with nothing else hung between them, are one segment
and move as one. Each segment is entered, read and left: these steps point to one another
and make one list a document, from its root to its end. In each round a step takes over
what the step it points to knows, so that a list of n steps is ranked after log2(n) joins,
whatever its depth. No document, chain or level is ever together in one task.

Defined results
    parents that are missing    what hangs below them is not read
    parents that form a cycle   likewise
    repeated characters         one of them counts
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut, numbered

#: Kinds of steps, and what a step that leads nowhere points to.
ENTER, READ, LEAVE, NOWHERE = 0, 1, 2, -1


def _step(segment: Column, kind: int) -> Column:
    return segment * 3 + kind


def segments(chars: DataFrame) -> DataFrame:
    """``chars`` with ``segment``: a number that runs of characters share where nothing hangs between them."""
    parent = ["object", "parent_counter", "parent_replica"]
    run = (F.col("side") == "right") & (F.col("parent_replica") == F.col("replica")) & (F.col("parent_counter") == F.col("counter") - 1)
    branches = chars.groupBy(*parent).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*parent, F.lit(True).alias("_branch"))
    # only what follows its own writer's last character looks its parent up: each has another
    inside = chars.where(run).join(branches, parent, "left").withColumn("start", F.coalesce("_branch", F.lit(False)).cast("long")).drop("_branch")
    every = inside.unionByName(chars.where(~F.coalesce(run, F.lit(False))).withColumn("start", F.lit(1).cast("long")))
    before = numbered(every, ["object", "replica", "counter"], "_before", F.col("start"))
    return cut(before.withColumn("segment", F.col("_before") + F.col("start")).drop("_before"))


def _tree(chars: DataFrame) -> DataFrame:
    """``segment, object, above, side, counter, replica, size``: a row a segment, and one for the root of each document, which is above nothing."""
    first = F.min_by(F.struct("counter", "replica", "parent_counter", "parent_replica", "side"), "counter").alias("f")
    each = chars.groupBy("segment").agg(F.first("object").alias("object"), first, F.count(F.lit(1)).alias("size"))
    each = cut(each.select("segment", "object", "f.*", "size"))
    n = each.count()
    objects = numbered(each.select("object").distinct(), ["object"], "_n").select((F.col("_n") + n).alias("segment"), "object")
    roots = cut(objects)
    ends = each.select("object", (F.col("counter") + F.col("size") - 1).alias("parent_counter"), F.col("replica").alias("parent_replica"), F.col("segment").alias("above"))
    hung = each.where("parent_counter > 0").join(ends, ["object", "parent_counter", "parent_replica"])
    top = each.where("parent_counter = 0").join(roots.withColumnRenamed("segment", "above"), "object")
    columns = ["segment", "object", "above", "side", "counter", "replica", "size"]
    none = lambda kind: F.lit(None).cast(kind)
    bare = roots.select("segment", "object", none("long").alias("above"), none("string").alias("side"), none("long").alias("counter"), none("string").alias("replica"), F.lit(0).cast("long").alias("size"))
    return cut(hung.select(*columns).unionByName(top.select(*columns)).unionByName(bare))


def _steps(tree: DataFrame) -> DataFrame:
    """``id, next, weight``: the list of steps; ``next`` is null at the end of a document."""
    order = numbered(tree.where("above IS NOT NULL").select("segment", "above", "side", "counter", "replica"), ["above", "side", "counter", "replica"], "k").select("segment", "above", "side", "k")
    order = cut(order)
    following = order.select((F.col("k") - 1).alias("k"), F.col("segment").alias("sibling"), F.col("above").alias("_a"), F.col("side").alias("_s"))
    beside = order.join(following, "k", "left").select("segment", F.when((F.col("_a") == F.col("above")) & (F.col("_s") == F.col("side")), F.col("sibling")).alias("sibling"))
    first = lambda side, name: order.where(F.col("side") == side).groupBy("above").agg(F.min_by("segment", "k").alias(name)).withColumnRenamed("above", "segment")
    nodes = tree.select("segment", "above", "side", "size").join(beside, "segment", "left").join(first("left", "left"), "segment", "left").join(first("right", "right"), "segment", "left")
    onward = F.when(F.col("sibling").isNotNull(), _step(F.col("sibling"), ENTER)).when(F.col("side") == "left", _step(F.col("above"), READ)).otherwise(_step(F.col("above"), LEAVE))
    after = F.when(F.col("right").isNotNull(), _step(F.col("right"), ENTER)).otherwise(onward)
    whole = F.col("left").isNull()
    last = F.least(F.col("size"), F.lit(1))
    step = lambda kind, to, weight: F.struct(_step(F.col("segment"), kind).alias("id"), to.alias("next"), weight.cast("long").alias("weight"))
    steps = F.array(
        step(ENTER, F.when(whole, after).otherwise(_step(F.col("left"), ENTER)), F.when(whole, F.col("size")).otherwise(F.col("size") - last)),
        F.when(~whole, step(READ, after, last)),
        F.when(F.col("right").isNotNull(), step(LEAVE, onward, F.lit(0))),
    )
    return nodes.select(F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("s.*")


def ranked(steps: DataFrame) -> DataFrame:
    """``id, rest``: the sum of ``weight`` from each step of ``steps(id, next, weight)`` to the end of its list.

    Lists that lead to a step which is not there, or round in a circle, are left out. At
    most one step points to each, so the join of a round meets one row with one.
    """
    now = cut(steps)
    rounds = max(now.count(), 1).bit_length() + 1
    for _ in range(rounds):
        going = now.where(F.col("next") >= 0)
        if going.isEmpty():
            break
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("weight").alias("_weight"), F.lit(True).alias("_there"))
        moved = going.join(ahead, "next", "left").select("id", F.when(F.col("_there"), F.col("_next")).otherwise(NOWHERE).alias("next"), (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"))
        now = cut(moved.unionByName(now.where(F.col("next").isNull() | (F.col("next") < 0))))
    return now.where(F.col("next").isNull()).select("id", F.col("weight").alias("rest"))


def places(chars: DataFrame) -> DataFrame:
    """``chars`` that can be read with ``place``, from 0 in each document.

    ``chars(object, counter, replica, parent_counter, parent_replica, side, ...)``; the parent of what
    hangs on the root has the counter 0.
    """
    named = segments(chars)
    tree = _tree(named)
    rest = cut(ranked(_steps(tree)))
    of = lambda kind, name: rest.where(F.col("id") % 3 == kind).select(F.floor(F.col("id") / 3).alias("segment"), F.col("rest").alias(name))
    totals = tree.where("above IS NULL").join(of(ENTER, "total"), "segment").select("object", "total")
    known = tree.where("above IS NOT NULL").select("segment", F.col("object").alias("_object"), F.col("counter").alias("_first"), "size").join(of(ENTER, "entered"), "segment").join(of(READ, "read"), "segment", "left")
    known = known.join(totals.withColumnRenamed("object", "_object"), "_object")
    offset = F.col("counter") - F.col("_first")
    apart = F.col("read").isNotNull() & (offset == F.col("size") - 1)
    place = F.col("total") - F.when(apart, F.col("read")).otherwise(F.col("entered") - offset)
    return named.join(known.drop("_object"), "segment").withColumn("place", place).select(*chars.columns, "place")
