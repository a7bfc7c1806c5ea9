"""The file tree: a fold of moves, and paths by joins up the parent pointers.

The fold takes moves in the order of (counter, replica) and skips one that would
put a node below itself. What a move does depends on all before it, so the moves
of one vault are folded by one task; different vaults spread by their id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import cut, numbered

ROOT, TRASH = "root", "trash"
SEPARATOR = "/"


def legal_name(name: Column) -> Column:
    return (name != "") & ~name.isin(".", "..") & ~name.contains("/")


def well_formed(moves: DataFrame) -> DataFrame:
    """Moves of ordinary nodes, under another node, with a legal name."""
    legal = legal_name(F.col("name"))
    usable = (F.col("counter") > 0) & ~F.col("child").isin(ROOT, TRASH) & (F.col("child") != F.col("parent"))
    return moves.where(usable & legal)


def fold(moves: DataFrame) -> DataFrame:
    """``vault, child, parent, name, is_dir``: where each node ends up."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        place: dict[str, tuple] = {}
        for row in pdf.sort_values(["counter", "replica"]).itertuples():
            above, below_itself = row.parent, False
            while above in place and not below_itself:
                below_itself = above == row.child
                above = place[above][0]
            if not (below_itself or above == row.child):
                place[row.child] = (row.parent, row.name, row.is_dir)
        vault = pdf["vault"].iloc[0]
        return pd.DataFrame([(vault, c, *p) for c, p in place.items()], columns=["vault", "child", "parent", "name", "is_dir"])

    each = well_formed(moves).dropDuplicates(["vault", "counter", "replica"])
    return each.groupBy("vault").applyInPandas(replay, "vault string, child string, parent string, name string, is_dir boolean")


def paths(nodes: DataFrame, root: str = ROOT) -> DataFrame:
    """``vault, child, path, is_dir`` of every node below ``root``.

    Pointers are doubled: in each round a node takes over the path and the pointer of the
    node it points to, so the rounds grow with the logarithm of the depth. What leads to no
    node, or round in a circle, is cut off: as a node has others at every depth above it,
    none is left once a round brings none to the root, and no path goes round for long.
    """
    now = cut(nodes.select("vault", "child", F.col("parent").alias("at"), F.col("name").alias("path"), "is_dir"))
    going = F.col("at") != root
    arrived = 0
    while True:
        left = now.where(going)
        before, arrived = arrived, now.where(~going).count()
        if arrived == before or left.isEmpty():
            break
        above = now.select("vault", F.col("child").alias("at"), F.col("at").alias("_at"), F.col("path").alias("_path"))
        moved = left.join(above, ["vault", "at"]).select("vault", "child", F.col("_at").alias("at"), F.concat_ws(SEPARATOR, "_path", "path").alias("path"), "is_dir")
        now = cut(now.where(~going).unionByName(moved))
    return now.where(~going).select("vault", "child", "path", "is_dir")


def listing(nodes: DataFrame) -> DataFrame:
    """Live files and folders by path, then id."""
    return paths(nodes).orderBy("vault", "path", "child")


def deleted(nodes: DataFrame) -> DataFrame:
    """Nodes that lead up to the trash."""
    return paths(nodes, TRASH).select("vault", "child")


def detached(nodes: DataFrame) -> DataFrame:
    """Nodes that lead up to neither the root nor the trash: in a cycle, or below a node that is not there."""
    held = paths(nodes).select("vault", "child").union(deleted(nodes))
    return nodes.select("vault", "child").join(held, ["vault", "child"], "left_anti")


def moves_for(events: DataFrame, clock: int, replica: str) -> DataFrame:
    """Change events of ``vault`` as moves: a deleted node goes to the trash, what arrives below its folder.

    ``events(vault, kind, path, id)``. A writer numbers its own moves one after the
    other, by path and kind, from ``clock`` on. What is only modified does not move.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    placed = numbered(events.where("kind <> 'modified'"), ["path", "kind"], "_place", within=("vault",))
    return placed.select(
        "vault",
        (F.col("_place") + clock).cast("long").alias("counter"),
        F.lit(replica).alias("replica"),
        F.coalesce("id", "path").alias("child"),
        F.when(F.col("kind") == "deleted", TRASH).when(folder == "", ROOT).otherwise(folder).alias("parent"),
        F.element_at(F.split("path", SEPARATOR), -1).alias("name"),
        F.lit(False).alias("is_dir"),
    )


def children(nodes: DataFrame, parent: str) -> DataFrame:
    return nodes.where(F.col("parent") == parent)


def compact_log(moves: DataFrame, watermark: int) -> DataFrame:
    """What remains of the log once everything up to the watermark is settled."""
    return moves.where(F.col("counter") > watermark)
