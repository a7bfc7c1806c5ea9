"""Sources: folders of notes, question files, and their sizes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import blake2
from marginalia.operators.snapshot import is_vault_file

STAT = "path string, is_dir boolean, dev long, ino long, nlink long, size long, mtime_ns long, ctime_ns long"


def note_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, modified``: every ``*.md`` below ``root`` whose names on the way do not start with a dot.

    Spark's own listing, from any store. It leaves out names that begin with an
    underscore; :func:`walk` finds those too where the folder is mounted.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    below = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}') + {len(root.rstrip('/')) + 1})")
    return files.select(below.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(r"(^|/)\."))


def note_texts(spark: SparkSession, root: str) -> DataFrame:
    """``path, content``: the bytes of every note."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    below = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}') + {len(root.rstrip('/')) + 1})")
    return files.select(below.alias("path"), "content").where(~F.col("path").rlike(r"(^|/)\."))


def dir_bytes(spark: SparkSession, root: str) -> DataFrame:
    """One row, ``bytes``; only lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Files and folders of a mounted folder with their identity, one task per top-level entry.

    Links are not followed; folders that cannot be read are left out.
    """
    tops = sorted(os.listdir(root))

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for top in batch["top"]:
                first = os.path.join(root, top)
                found = [first]
                if os.path.isdir(first) and not os.path.islink(first):
                    for folder, folders, files in os.walk(first):
                        found += [os.path.join(folder, n) for n in sorted(folders + files)]
                rows = []
                for path in found:
                    s = os.lstat(path)
                    is_dir = os.path.isdir(path) and not os.path.islink(path)
                    if is_dir or (os.path.isfile(path) and not os.path.islink(path)):
                        rows.append((os.path.relpath(path, root), is_dir, s.st_dev, s.st_ino, s.st_nlink, s.st_size, s.st_mtime_ns, s.st_ctime_ns))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in STAT.split(", ")])

    entries = spark.createDataFrame([(t,) for t in tops], "top string").repartition(max(len(tops), 1))
    return entries.mapInPandas(below, STAT)


def census(spark: SparkSession, root: str, tries: int = 4) -> DataFrame:
    """``path, id, dev, ino, nlink, hash, stable`` of the notes in a mounted folder; ids are for new files to be given.

    A file that changes while it is read is read again, ``tries`` times in all; one that
    never settles is not stable and has no hash. What is gone by then is not there.
    """

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept = []
            for r in batch.itertuples():
                row = stable_read(os.path.join(root, r.path), tries)
                if row is not None:
                    kept.append((r.path, *row))
            yield pd.DataFrame(kept, columns=["path", "dev", "ino", "nlink", "content", "stable"])

    files = walk(spark, root).where(~F.col("is_dir") & is_vault_file(F.col("path"))).select("path")
    read = files.mapInPandas(contents, "path string, dev long, ino long, nlink long, content binary, stable boolean")
    return read.select("path", F.lit(None).cast("string").alias("id"), "dev", "ino", "nlink", blake2(32)("content").alias("hash"), "stable")


def stable_read(path: str, tries: int = 4, content: Callable[[str], bytes] | None = None) -> tuple | None:
    """``dev, ino, nlink, content, stable`` of a file, None where there is none."""
    identity = lambda s: (s.st_mtime_ns, s.st_size, s.st_ino, s.st_ctime_ns)
    try:
        for _ in range(tries):
            before = os.stat(path)
            data = content(path) if content else _bytes(path)
            after = os.stat(path)
            if identity(before) == identity(after):
                return after.st_dev, after.st_ino, after.st_nlink, data, True
    except FileNotFoundError:
        return None
    return after.st_dev, after.st_ino, after.st_nlink, None, False


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """``path, id, dev, ino, nlink, hash`` of the notes that could be read as one state."""
    return census(spark, root).where("stable").drop("stable")


def primed(census: DataFrame) -> DataFrame:
    """A first snapshot with an id for each file, the same whenever it is taken again: from its inode and its path."""
    return census.withColumn("id", F.coalesce("id", F.sha2(F.concat_ws(":", "dev", "ino", "path"), 256).substr(1, 32)))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """``question, expected``: tab-separated, ``#`` for comments, a null where refusing is right."""
    rows = spark.read.csv(path, sep="\t", comment="#", quote="", schema="question string, expected string")
    return rows.select("question", F.when(F.col("expected") != "NONE", F.col("expected")).alias("expected"))
