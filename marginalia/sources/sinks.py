"""Sinks: keyed appends that may be repeated, events as JSON, and texts to files."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder or a file at ``path``, in whatever store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append what is not there yet by its keys: sending a batch again changes nothing."""
    spark, fresh = rows.sparkSession, rows.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def advance(moved: DataFrame, path: str, keys: list[str]) -> None:
    """Record how far each cursor of ``moved(*keys, counter)`` has come; nothing is rewritten."""
    moved.groupBy(*keys).agg(F.max("counter").alias("counter")).write.mode("append").parquet(path)


def cursors(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Where each cursor stands: the furthest of all that was recorded."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.max("counter").alias("counter"))


def json_events(rows: DataFrame, kind: str) -> DataFrame:
    """One JSON object per row under ``event``, with the kind first."""
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("event"), *rows.columns)).alias("value"))


def write_json_events(rows: DataFrame, kind: str, path: str) -> None:
    json_events(rows, kind).write.mode("append").text(path)


def write_segments(entries: DataFrame, manifest: DataFrame, index: str) -> None:
    """Entries first, by segment, and only then the manifest rows that name them."""
    entries.write.mode("append").partitionBy("segment").parquet(f"{index}/entries")
    manifest.write.mode("append").parquet(f"{index}/manifest")


def materialise(texts: DataFrame, folder: str) -> DataFrame:
    """Write ``texts(path, text)`` into a mounted folder where they differ: ``path, written``."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for path, text in zip(batch["path"], batch["text"]):
                where, data = os.path.join(folder, path), (text or "").encode()
                same = os.path.exists(where) and open(where, "rb").read() == data
                if not same:
                    os.makedirs(os.path.dirname(where), exist_ok=True)
                    with open(where + ".new", "wb") as f:
                        f.write(data)
                    os.replace(where + ".new", where)
                done.append((path, not same))
            yield pd.DataFrame(done, columns=["path", "written"])

    return texts.select("path", "text").mapInPandas(write, "path string, written boolean")
