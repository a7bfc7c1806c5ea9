"""An outbox that is drained in two steps: rows are claimed, handed over, and acknowledged.

A claim names the rows of one hand-over before anything leaves; it is there again, with the
same number and the same rows, until it is acknowledged. What takes rows knows a claim by
its number (:func:`keyed.merge` does), so a drain that stops between any two steps and is
run again delivers each row once in effect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import cut, numbered
from marginalia.sources.sinks import exists


class Outbox:
    """Rows under ``path`` that are told apart by ``keys``, handed over in their order, ``page`` at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], page: int) -> None:
        self.spark, self.path, self.keys, self.page = spark, path, keys, page

    def put(self, rows: DataFrame) -> None:
        rows.dropDuplicates(self.keys).write.mode("append").parquet(f"{self.path}/rows")

    def _table(self, name: str, schema: str) -> DataFrame:
        read = self.spark.read.schema(schema)
        return read.parquet(f"{self.path}/{name}") if exists(self.spark, f"{self.path}/{name}") else self.spark.createDataFrame([], schema)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").dropDuplicates(self.keys)

    def _claims(self) -> DataFrame:
        """``*keys, claim``: each row in the first claim that names it."""
        types = dict(self._rows().dtypes)
        schema = ", ".join(f"`{k}` {types[k]}" for k in self.keys) + ", claim long"
        return self._table("claims", schema).groupBy(*self.keys).agg(F.min("claim").alias("claim"))

    def _acknowledged(self) -> DataFrame:
        return self._table("acknowledged", "claim long").distinct()

    def pending(self) -> DataFrame:
        """Rows that no acknowledged claim names."""
        gone = self._claims().join(self._acknowledged(), "claim", "left_semi").drop("claim")
        return self._rows().join(gone, self.keys, "left_anti")

    def claim(self) -> tuple[int, DataFrame] | None:
        """The number and the rows of the next hand-over: a claim that is open, or the next page; None where nothing waits."""
        claims = cut(self._claims())
        last = claims.agg(F.max("claim").alias("last")).first().last
        open_ = claims.join(self._acknowledged(), "claim", "left_anti").agg(F.min("claim").alias("first")).first().first
        if open_ is None:
            unclaimed = self._rows().select(*self.keys).join(claims.drop("claim"), self.keys, "left_anti")
            page = numbered(unclaimed, self.keys).where(F.col("place") <= self.page).select(*self.keys)
            open_ = (last or 0) + 1
            marked = cut(page.withColumn("claim", F.lit(open_).cast("long")))
            if marked.isEmpty():
                return None
            marked.write.mode("append").parquet(f"{self.path}/claims")
        ours = self._claims().where(F.col("claim") == open_).drop("claim")
        return open_, self._rows().join(ours, self.keys, "left_semi")

    def acknowledge(self, claim: int) -> None:
        self.spark.createDataFrame([(claim,)], "claim long").coalesce(1).write.mode("append").parquet(f"{self.path}/acknowledged")

    def drain(self, deliver: Callable[[DataFrame, int], object]) -> int:
        """Hand over everything that waits: how many claims it took."""
        n = 0
        while (claimed := self.claim()) is not None:
            number, rows = claimed
            deliver(rows, number)
            self.acknowledge(number)
            n += 1
        return n
