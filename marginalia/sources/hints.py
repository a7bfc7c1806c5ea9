"""Hints by hand: a log of paths to look at again, and a streaming source that reads it.

The log is a folder that all executors have mounted, an entry a file, numbered from 0. An
offset is the number of the next entry, so a stream goes on where it stopped, and a batch
that comes again reads the same entries. Entries may be lost: a log keeps only so many.
Whoever was to read one gets a hint for the root in its place, renamed by nobody, and
looks at everything once: more than was asked, never less.

Defined results
    null paths             no hint
    the empty path         everything
    an entry that is cut short     a hint for the root
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

ROOT_HINT = ("", False)
#: Hints of one entry that a task writes at the most.
ENTRY = 50_000


def _numbers(path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in os.listdir(path) if n.endswith(".json") and n[:-5].isdigit()) if os.path.isdir(path) else []


class HintLog:
    """Writes entries; one writer at a time. ``path`` may be a local path or a ``file:`` one."""

    def __init__(self, path: str) -> None:
        self.path = mounted(path)
        os.makedirs(self.path, exist_ok=True)

    def _next(self) -> int:
        known = _numbers(self.path)
        kept = os.path.join(self.path, "first")
        low = int(open(kept).read()) if os.path.exists(kept) else 0
        return max(known[-1] + 1 if known else 0, low)

    def emit(self, hints: Iterable[tuple[str, bool]]) -> None:
        """One entry of ``(path, renamed)``."""
        name = os.path.join(self.path, f"{uuid.uuid4().hex}.new")
        with open(name, "w") as f:
            f.writelines(json.dumps([p, bool(r)]) + "\n" for p, r in hints if p is not None)
        os.replace(name, os.path.join(self.path, f"{self._next()}.json"))

    def emit_all(self, hints: DataFrame) -> None:
        """The rows ``path, renamed``, an entry for each ENTRY rows of a task; numbered here, where only names are seen."""
        staged = os.path.join(self.path, f"staged-{uuid.uuid4().hex}")
        os.makedirs(staged)

        def write(batches: Iterator[pd.DataFrame], most: int = ENTRY) -> Iterator[pd.DataFrame]:
            names, sizes = [], []
            for batch in batches:
                for low in range(0, len(batch), most):
                    some = batch.iloc[low : low + most]
                    if not names or sizes[-1] + len(some) > most:
                        names.append(uuid.uuid4().hex)
                        sizes.append(0)
                    sizes[-1] += len(some)
                    with open(f"{staged}/{names[-1]}", "a") as f:
                        f.writelines(json.dumps([p, bool(r)]) + "\n" for p, r in zip(some["path"], some["renamed"]))
            if names:  # a task may have no rows
                yield pd.DataFrame({"name": names, "n": sizes})

        # what a task wrote counts if it is told of: another try of it has another name
        written = hints.where("path IS NOT NULL").select("path", F.coalesce("renamed", F.lit(False)).alias("renamed")).mapInPandas(write, "name string, n long")
        for k, r in enumerate(written.where("n > 0").orderBy("name").collect(), self._next()):
            os.replace(f"{staged}/{r.name}", os.path.join(self.path, f"{k}.json"))

    def keep(self, entries: int) -> None:
        """Lose all but the last ``entries``."""
        known = _numbers(self.path)
        lost = known[: max(len(known) - entries, 0)]
        with open(os.path.join(self.path, "first.new"), "w") as f:
            f.write(str(self._next() if len(lost) == len(known) else known[len(lost)]))
        os.replace(os.path.join(self.path, "first.new"), os.path.join(self.path, "first"))
        for n in lost:
            os.remove(os.path.join(self.path, f"{n}.json"))


def mounted(path: str) -> str:
    return path[path.index(":") + 1 :].replace("//", "/") if path.startswith("file:") else path


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": HintLog(self.path)._next()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A partition an entry; all that are lost share one."""
        wanted, there = range(start["next"], end["next"]), set(_numbers(self.path))
        found = [InputPartition(n) for n in wanted if n in there]
        return found + ([InputPartition(None)] if len(found) < len(wanted) else [])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            with open(os.path.join(self.path, f"{partition.value}.json")) as f:
                hints = [tuple(json.loads(line)) for line in f]
        except (OSError, ValueError):
            hints = [ROOT_HINT]
        yield from hints

    def commit(self, end: dict) -> None:
        pass


class HintSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hints"

    def schema(self) -> str:
        return "path string, renamed boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(mounted(self.options["path"]))


def hint_stream(spark: SparkSession, path: str) -> DataFrame:
    """``path, renamed`` of a hint log as a stream."""
    spark.dataSource.register(HintSource)
    return spark.readStream.format("hints").option("path", path).load()
