"""A table with one row a key, merged a bucket at a time: what a relay keeps of pushes, reports and pieces.

Rows lie in buckets by a hash of their key. A merge reads the buckets that its rows fall
into, and no other, writes those buckets anew beside the old ones, and last of all notes
which buckets it wrote; a reader takes of each bucket what was noted last. So a merge that
breaks off leaves nothing that counts, and one that comes again by its number is known and
does nothing. :func:`tidy` takes away what no reader takes any more.

Two laws for a key that is there already:
    newest   the row that is last in the given order stays, whichever came first
    first    what is there stays; the same row again changes nothing, one with other
             values is refused

Defined results
    null in a key        a key like any other
    equal rows           one of them
    ties of the order    the greater row, column by column
    no rows              nothing is written, the number is noted
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import cut
from marginalia.sources.sinks import exists

BUCKETS = 64
NOTES = "n long, version string, bucket int"


def _notes(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(NOTES).parquet(f"{path}/notes") if exists(spark, f"{path}/notes") else None


def _current(spark: SparkSession, path: str) -> dict[int, str]:
    """The version of each bucket that counts: one for each of them at the most."""
    notes = _notes(spark, path)
    if notes is None:
        return {}
    last = notes.where("bucket IS NOT NULL").groupBy("bucket").agg(F.max_by("version", "n").alias("version"))
    return {r.bucket: r.version for r in last.collect()}


def _versions(spark: SparkSession, path: str, wanted: dict[int, str]) -> DataFrame:
    """The rows of some versions of buckets; Spark lists and reads their folders alone."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/bucket={b}/version={v}" for b, v in sorted(wanted.items())])
    return rows.drop("version")


def read(spark: SparkSession, path: str, keys: dict | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The table; with ``keys``, a value for each key column, only that key's bucket is read."""
    current = _current(spark, path)
    if keys is not None:
        bucket = spark.range(1).select(_bucket([F.lit(v) for v in keys.values()], buckets)).first()[0]
        current = {b: v for b, v in current.items() if b == bucket}
    if not current:
        raise AnalysisException(message=f"no rows at {path}" if keys is None else f"no rows in the bucket of {keys} at {path}")
    rows = _versions(spark, path, current).drop("bucket")
    for name, value in (keys or {}).items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows


def _bucket(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge(rows: DataFrame, path: str, keys: list[str], number: int, newest: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Merge ``rows`` as batch ``number``: the rows that were refused.

    With ``newest`` the row of a key that is last by those columns stays; without, the first
    that came. Batches are merged one after the other; ``number`` grows, and one that was
    merged before is left out. ``keys`` and ``buckets`` are those of the table for good.
    """
    spark = rows.sparkSession
    notes = _notes(spark, path)
    if notes is not None and not notes.where(F.col("n") == number).isEmpty():
        return rows.limit(0)
    fresh = cut(rows.distinct().withColumn("bucket", _bucket([F.col(k) for k in keys], buckets)))
    # a number a bucket
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
    there = {b: v for b, v in _current(spark, path).items() if b in touched}
    every = fresh.withColumn("_old", F.lit(False))
    if there:
        every = _versions(spark, path, there).select(*fresh.columns).withColumn("_old", F.lit(True)).unionByName(every)
    whole = F.struct(*rows.columns)
    order = F.struct(*newest, whole) if newest else F.struct("_old", whole)
    stays = cut(every.groupBy("bucket", *keys).agg(F.max_by(whole, order).alias("row")))
    version = uuid.uuid4().hex
    if touched:
        stays.select("row.*", "bucket", F.lit(version).alias("version")).repartition("bucket").write.mode("append").partitionBy("bucket", "version").parquet(f"{path}/rows")
    told = [(number, version, b) for b in touched] or [(number, version, None)]
    spark.createDataFrame(told, NOTES).coalesce(1).write.mode("append").parquet(f"{path}/notes")
    if newest:
        return rows.limit(0)
    same = stays.select(*[F.col(f"row.{c}").alias(c) for c in rows.columns], F.lit(True).alias("_kept"))
    alike = [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in rows.columns]
    condition = alike[0]
    for a in alike[1:]:
        condition = condition & a
    return fresh.alias("f").join(same.alias("s"), condition, "left_anti").select(*[F.col(f"f.{c}") for c in rows.columns])


def tidy(spark: SparkSession, path: str) -> int:
    """Remove the folders of versions that no longer count: how many there were. Nothing may be merged meanwhile."""
    kept = {f"bucket={b}/version={v}" for b, v in _current(spark, path).items()}
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    removed = 0
    for bucket in fs.listStatus(files):
        if bucket.isDirectory():
            for version in fs.listStatus(bucket.getPath()):
                if f"{bucket.getPath().getName()}/{version.getPath().getName()}" not in kept:
                    fs.delete(version.getPath(), True)
                    removed += 1
    return removed
