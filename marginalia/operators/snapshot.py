"""Change detection: two snapshots of a folder to typed events, as joins.

A snapshot row is ``path, id, dev, ino, nlink, hash``. The path is the identity;
the inode is evidence of a move, and only where a rename was also reported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of kinds under one path.
KINDS = ("created", "modified", "deleted", "moved")


def is_vault_file(path: Column) -> Column:
    """``.md`` in any ASCII case, and a name that starts with neither ``.`` nor ``#``."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.rlike(r"\.[mM][dD]$") & ~name.rlike(r"^[.#]")


def is_under(path: Column, prefix: Column) -> Column:
    """At or below a folder; the empty prefix covers everything."""
    return (prefix == "") | (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def hinted(paths: DataFrame, hints: DataFrame) -> DataFrame:
    """Paths that a hint covers, with whether any of those hints reported a rename.

    A path is joined to hints by its own ancestors, so the prefix join is an
    equality join and does not compare every path with every hint. What the root was
    told is one row for all paths: they never meet under its name.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    every = paths.where("path IS NOT NULL").select("path").distinct()
    spread = every.select("path", F.explode(F.filter(ancestors, lambda a: a != "")).alias("hint"))
    asked = hints.where("path <> ''").groupBy(F.col("path").alias("hint")).agg(F.bool_or("renamed").alias("renamed"))
    own = spread.join(asked, "hint").groupBy("path").agg(F.bool_or("renamed").alias("_own"), F.lit(True).alias("_named"))
    root = hints.where("path = ''").agg((F.count(F.lit(1)) > 0).alias("_all"), F.bool_or("renamed").alias("_root"))
    found = every.join(own, "path", "left").crossJoin(F.broadcast(root)).where(F.col("_named") | F.col("_all"))
    return found.select("path", F.coalesce(F.col("_own") | F.col("_root"), "_own", "_root").alias("renamed"))


def deltas(before: DataFrame, now: DataFrame) -> DataFrame:
    """Full outer join by path: ``path, old, new``, and which side left or brought an identity."""
    row = lambda d, name: d.select("path", F.struct(*[c for c in d.columns if c != "path"]).alias(name))
    joined = row(before, "old").join(row(now, "new"), "path", "full_outer")
    replaced = F.col("old").isNotNull() & F.col("new").isNotNull() & (
        (F.col("old.dev") != F.col("new.dev")) | (F.col("old.ino") != F.col("new.ino"))
    )
    return joined.withColumn("arrived", F.col("new").isNotNull() & (F.col("old").isNull() | replaced)).withColumn(
        "vacated", F.col("old").isNotNull() & (F.col("new").isNull() | replaced)
    )


def moves(changed: DataFrame, renamed: DataFrame) -> DataFrame:
    """``path, old_path, id, hash``: one arrival and one vacancy of an inode, at different paths.

    Refused where either has further names (hard links) or no rename was reported
    on at least one end (a reused inode). ``renamed(path, renamed)``.
    """
    flags = renamed.where("renamed").select("path").distinct()

    def ends(side: str, when: str) -> DataFrame:
        rows = changed.where(when).select(F.col(f"{side}.dev").alias("dev"), F.col(f"{side}.ino").alias("ino"), "path", side)
        rows = rows.join(flags.withColumn("flag", F.lit(True)), "path", "left")
        only = F.min(F.struct("path", side, "flag")).alias(when)
        return rows.groupBy("dev", "ino").agg(F.count(F.lit(1)).alias("n"), only).where("n = 1").drop("n")

    pairs = ends("new", "arrived").join(ends("old", "vacated"), ["dev", "ino"])
    told = F.coalesce("arrived.flag", "vacated.flag").isNotNull()
    single = (F.col("arrived.new.nlink") <= 1) & (F.col("vacated.old.nlink") <= 1)
    return pairs.where((F.col("arrived.path") != F.col("vacated.path")) & told & single).select(
        F.col("arrived.path").alias("path"), F.col("vacated.path").alias("old_path"), F.col("vacated.old.id").alias("id"), F.col("arrived.new.hash").alias("hash")
    )


def reconcile(before: DataFrame, now: DataFrame, renamed: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Events ``kind, path, old_path, id, hash``; nothing for what is touched but unchanged.

    A created file has no id yet: its id is given where the event is stored. What is read
    more than once goes through ``keep``: written there, its joins are planned and run once.
    """
    changed = keep(deltas(before, now))
    moved = keep(moves(changed, renamed))
    rest = (
        changed.join(moved.select("path", F.lit(True).alias("took")), "path", "left")
        .join(moved.select(F.col("old_path").alias("path"), F.lit(True).alias("gave")), "path", "left")
        .withColumn("arrives", F.col("arrived") & F.col("took").isNull())
        .withColumn("vacates", F.col("vacated") & F.col("gave").isNull())
    )
    differs = F.col("old.hash") != F.col("new.hash")
    in_place = F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("arrived") & ~F.col("vacated")
    kind = (
        F.when(F.col("arrives") & F.col("vacates"), F.when(differs, "modified"))
        .when(F.col("arrives"), "created")
        .when(F.col("vacates"), "deleted")
        .when(in_place & differs, "modified")
    )
    others = rest.withColumn("kind", kind).where("kind IS NOT NULL").select(
        "kind", "path", F.lit(None).cast("string").alias("old_path"), F.when(F.col("kind") != "created", F.col("old.id")).alias("id"),
        F.when(F.col("kind") != "deleted", F.col("new.hash")).alias("hash"),
    )
    return others.unionByName(moved.select(F.lit("moved").alias("kind"), "path", "old_path", "id", "hash"))


def in_order(events: DataFrame) -> DataFrame:
    """By the path an event is about, then by kind."""
    return events.orderBy("path", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")))


def local_changes(files: DataFrame, materialised: DataFrame) -> DataFrame:
    """Files whose text is not what the log says, or of which it says nothing."""
    known = materialised.select("path", F.col("text").alias("_known"), F.lit(True).alias("_there"))
    joined = files.join(known, "path", "left")
    kind = F.when(F.col("_there").isNull(), "created").when(~F.col("text").eqNullSafe(F.col("_known")), "modified")
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").drop("_known", "_there")


def fold_case(name: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def case_collisions(paths: DataFrame) -> DataFrame:
    """Different paths that are one on a file system without case: ``folded, n, paths``."""
    return (
        paths.select(fold_case(F.col("path")).alias("folded"), "path")
        .groupBy("folded")
        .agg(F.count_distinct("path").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
        .where("n > 1")
    )
