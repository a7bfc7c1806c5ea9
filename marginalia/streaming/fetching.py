"""What a running stream counts of itself: metrics observed on the way, added up over its batches."""

from __future__ import annotations

from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


@dataclass
class Fetched:
    """Of one object: rows that came, rows that were new, the others, and the highest counter."""

    object: str
    fetched: int = 0
    applied: int = 0
    repeats: int = 0
    cursor_after: int = 0


class Counter(StreamingQueryListener):
    """Adds up the observed metrics of one query, each batch once."""

    def __init__(self, objects: list[str]) -> None:
        self.stats, self.run, self.batches, self.lock = [Fetched(o) for o in objects], None, set(), Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def add(self, progress) -> None:
        """Count a batch of this run; the listener and its owner may both tell of it."""
        seen = progress.observedMetrics
        with self.lock:
            if str(progress.runId) != self.run or not {"came", "new"} <= set(seen) or progress.batchId in self.batches:
                return
            self.batches.add(progress.batchId)
        for k, s in enumerate(self.stats):
            came, new = seen["came"][f"n{k}"] or 0, seen["new"][f"n{k}"] or 0
            s.fetched, s.applied, s.repeats = s.fetched + came, s.applied + new, s.repeats + came - new
            s.cursor_after = max(s.cursor_after, seen["came"][f"high{k}"] or 0)


def _counts(objects: list[str]) -> list:
    is_ = lambda o: F.col("object") == F.lit(o)
    return [c for k, o in enumerate(objects) for c in (F.count_if(is_(o)).alias(f"n{k}"), F.max(F.when(is_(o), F.col("counter"))).alias(f"high{k}"))]


def fetched(ops: DataFrame, objects: list[str], checkpoint: str, out: str) -> list[Fetched]:
    """Drain the stream ``ops(object, replica, counter)`` to files, each operation once: what it counted of ``objects``.

    Nothing is read again to be counted: rows are counted where they come in and again
    behind the removal of repeats, and each batch reports both with its progress. Batches
    that an earlier run of the same checkpoint has ended are not counted here.
    """
    counter = Counter(objects)
    new = ops.observe("came", *_counts(objects)).dropDuplicates(["object", "replica", "counter"]).observe("new", *_counts(objects))
    streams = ops.sparkSession.streams
    streams.addListener(counter)
    try:
        query = new.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start()
        counter.run = str(query.runId)
        query.awaitTermination()
        for progress in query.recentProgress:  # what the listener has not been told yet
            counter.add(progress)
    finally:
        streams.removeListener(counter)
    return counter.stats
