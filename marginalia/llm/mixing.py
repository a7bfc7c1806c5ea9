"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's documents stand in one order; each is worth ``rate = target / size of
the source`` copies. With one offset per source, a document is emitted once for
every integer that the running sum crosses while passing it. The running sum is
rank times rate, and the rank is a prefix sum in two levels: counts per bucket of
a source, then a row number inside a bucket. A bucket is a size class and a salt, of
which there are as many as the table needs, so a source that holds a third of all rows still spreads over many tasks, and as
the order runs by size class the words taken come close to the target.

Defined results
    null text       size 0; null source is a source of its own, placed last
    size 0          such rows are worth the same number of copies, of no words
    ties            rows equal in size and id are interchangeable
    empty table     an empty result
    no words        all targets are 0 and nothing is taken
    other columns   carried through; clashing names are replaced
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed by the task: weights by the source's place, the share of all words, the most copies.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Salts of a size class at the least, and rows of a table that one more of them stands for.
SALTS, SALT_ROWS = 64, 4_000_000
RESULT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes to a doubling, from integers alone."""
    shift = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return shift * 16 + F.floor(size / F.pow(F.lit(2.0), shift))


def source_targets(
    sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """Targets for ``sources(source, source_size)``, one row per source.

    The excess over the caps is shared again by weight until no source is over
    its cap. That fixed point is ``min(cap, level * weight)``; with sources in
    order of cap / weight, those below the level form a prefix, so the level
    falls out of two running sums.
    """
    place = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    table = F.array(*[F.lit(w) for w in weights])
    placed = (
        sources.withColumn("place", F.row_number().over(place) - 1)
        .withColumn("weight", F.element_at(table, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    order = Window.orderBy("ratio", "place")
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        placed.withColumn("wanted", F.sum("source_size").over(all_rows) * share)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("wanted") - F.col("cap_before")) / F.col("weight_from"))
        # the first source whose cap is not below the level, and all after it, take level * weight
        .withColumn("open", F.col("ratio") >= F.col("level"))
        .withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(all_rows))
    )
    return level.select(
        "source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) for a source, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def salt(key: Column, size: Column, salts: int) -> Column:
    """A number under ``salts`` by a digest, so that ids with a common factor, and null ones of many sizes, are spread."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), size).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(salts))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 7,
) -> DataFrame:
    """Every row of ``docs`` with ``size, source_size, target, copies, taken``."""
    salts = max(SALTS, -(-docs.count() // SALT_ROWS))
    keep = [c for c in docs.columns if c not in RESULT]
    # the explode of one value keeps Catalyst from counting again for each use of the size
    sized = docs.withColumn("size", F.explode(F.array(word_count(docs[text_col])))).select(*keep, "size")
    rows = (
        sized.withColumn("__mix_class", size_class(F.col("size")))
        .withColumn("__mix_salt", salt(F.col(id_col), F.col("size"), salts))
        .withColumn("__mix_src", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")))
    )
    keys = ["__mix_src", "__mix_class", "__mix_salt"]
    # counted once for both uses below; a row per source, class and salt
    buckets = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__mix_n"), F.sum("size").alias("__mix_words")))
    targets = source_targets(
        buckets.groupBy(F.expr("if(__mix_src = 'n', null, substring(__mix_src, 2))").alias("source")).agg(F.sum("__mix_words").alias("source_size"))
    ).withColumn("__mix_src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    before = Window.partitionBy("__mix_src").orderBy("__mix_class", "__mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("__mix_before", F.coalesce(F.sum("__mix_n").over(before), F.lit(0)))
    placed = placed.join(targets, "__mix_src").select(*keys, "__mix_before", "source_size", "target")
    inside = Window.partitionBy(*keys).orderBy("size", id_col)
    ranked = rows.withColumn("__mix_rank", F.row_number().over(inside))
    # the same keys as the row numbers: the rows stay where they are
    joined = ranked.join(placed, keys)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank, start = F.col("__mix_before") + F.col("__mix_rank"), offset(F.col(source_col), seed)
    crossed = F.floor(rank * rate + start) - F.floor((rank - 1) * rate + start)
    return joined.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select(
        *keep, *RESULT
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as many times as it is taken."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
