"""Structured Streaming flows: debounced hints, gap-checked logs, running manifests and snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators import snapshot
from marginalia.session import cut, shared_dir, stored
from marginalia.sources.sinks import append_new
from marginalia.streaming.stateful import bucket

QUIET_MS, MAX_DELAY_MS = 40, 400
#: What tells manifest operations apart.
MANIFEST_ID = ["counter", "replica"]


def debounced(hints: DataFrame, quiet_ms: int = QUIET_MS, max_delay_ms: int = MAX_DELAY_MS) -> DataFrame:
    """``vault, path, renamed, flushed_at`` from a stream of ``vault, path, renamed, ts``.

    A vault's hints wait until it has been quiet for a while or the oldest has
    waited long enough, by event time. A path is flushed once, renamed if any of
    its hints was. State is the pending paths of the vaults of one bucket: calls and
    state of a group cost more than a vault, so that many vaults share one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = {vault: (held, oldest, newest) for vault, held, oldest, newest in json.loads(state.get[0])} if state.exists else {}
        out, hinted = [], {}

        def flush(vault: str, held: dict, at: int) -> None:
            out.extend((vault, path, flag == "1", at) for path, flag in sorted(held.items()))
            held.clear()

        for b in batches:
            times = (b["ts"].to_numpy("datetime64[ns]").astype("int64") // 1_000_000).tolist()
            for vault, ts, path, renamed in zip(b["vault"].tolist(), times, b["path"].tolist(), b["renamed"].tolist()):
                if vault is not None:  # hints of nobody only move the watermark on
                    hinted.setdefault(vault, []).append((ts, path, bool(renamed)))
        for vault, rows in hinted.items():
            held, oldest, newest = waiting.get(vault, ({}, -1, -1))
            for ts, path, renamed in sorted(rows):
                due = min(newest + quiet_ms, oldest + max_delay_ms)
                if held and ts >= due:
                    flush(vault, held, due)
                if not held:
                    oldest = ts
                newest = max(newest, ts) if held else ts
                held[path] = "1" if renamed or held.get(path) == "1" else "0"
            waiting[vault] = held, oldest, newest
        passed, first, left = state.getCurrentWatermarkMs(), None, []
        for vault, (held, oldest, newest) in waiting.items():
            due = min(newest + quiet_ms, oldest + max_delay_ms)
            if passed >= due:
                flush(vault, held, due)
            if held:
                first = due if first is None else min(first, due)
                left.append((vault, held, oldest, newest))
        if left:
            state.update((json.dumps(left),))
            state.setTimeoutTimestamp(max(first, passed + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["vault", "path", "renamed", "flushed_at"])

    rows = hints.select("vault", "path", "renamed", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", f"{max_delay_ms} milliseconds")
    return rows.withColumn("bucket", bucket("vault")).groupBy("bucket").applyInPandasWithState(
        step, "vault string, path string, renamed boolean, flushed_at long", "pending string", "append", GroupStateTimeout.EventTimeTimeout
    )


def gap_checked(ops: DataFrame) -> DataFrame:
    """Operations of a stream in the order of their chain; what follows a gap waits for it to close.

    State per object and replica, of all of one bucket: the last counter let through, and
    the rows that wait, as counter and prev. Repeats are dropped. Chains are many and short,
    and calls and state of a group cost more than a chain, so that many share one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chains = {(o, r): (last, {p: c for c, p in waits}) for o, r, last, waits in json.loads(state.get[0])} if state.exists else {}
        moved = {}
        for b in batches:
            for o, r, counter, prev in zip(*(b[c].tolist() for c in ("object", "replica", "counter", "prev"))):
                last, held = chains.get((o, r)) or chains.setdefault((o, r), (0, {}))
                if counter > last:
                    held[int(prev)] = int(counter)
                    moved[o, r] = True
        out = []
        for o, r in moved:
            last, held = chains[o, r]
            while last in held:
                last = held.pop(last)
                out.append((o, r, last))
            chains[o, r] = last, {p: c for p, c in held.items() if c > last}
        state.update((json.dumps([(o, r, last, sorted((c, p) for p, c in held.items())) for (o, r), (last, held) in chains.items()]),))
        yield pd.DataFrame(out, columns=["object", "replica", "counter"])

    rows = ops.select("object", "replica", "counter", "prev").withColumn("bucket", bucket("object", "replica"))
    return rows.groupBy("bucket").applyInPandasWithState(
        step, "object string, replica string, counter long", "chains string", "append", GroupStateTimeout.NoTimeout
    )


def manifest_totals(ops: DataFrame) -> DataFrame:
    """A running fold of manifest operations: adds, dead slots and retirements per segment."""
    return totals(ops.dropDuplicates(MANIFEST_ID))


def totals(ops: DataFrame) -> DataFrame:
    """The fold of operations that are there once."""
    kind = F.col("kind")
    return ops.groupBy("segment").agg(
        F.max(F.when(kind == "add", F.col("count"))).alias("count"),
        F.size(F.collect_set(F.when(kind == "tombstone", F.col("slot")))).alias("dead"),
        F.size(F.collect_set(F.when(kind == "retire", F.col("superseded_by")))).alias("retired"),
    )


def apply_pages(state_path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: append a page by its keys, so a page that comes again changes nothing."""
    def batch(rows: DataFrame, _: int) -> None:
        append_new(rows, state_path, keys)

    return batch


def reconcile_batches(
    spark: SparkSession, previous: DataFrame, current: Callable[[], DataFrame], emit: Callable[[DataFrame], None], kept: str | None = None,
    retry: Callable[[DataFrame], None] | None = None,
):
    """For ``foreachBatch`` over debounced hints: look at what they cover, emit events, keep the new snapshot.

    Snapshots are written under ``kept`` by the batch that made them, and a batch goes on
    from the latest one before it; so a restart, or a batch that comes again, finds what
    it had before. ``previous`` counts where there is none.

    A row of ``current()`` whose ``stable`` is false could not be read as one state: what is
    known of its path stays as it was, and the path goes back to ``retry(path, renamed)``.
    """
    base = kept or f"{shared_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/{n}")
        marks = spark.createDataFrame([(n,)], "batch long")
        append_new(marks, f"{base}/batches", ["batch"])

    def latest(n: int) -> DataFrame:
        done = spark.read.parquet(f"{base}/batches").where(F.col("batch") < n).agg(F.max("batch")).first()[0]
        return spark.read.parquet(f"{base}/{done}")

    append_new(spark.createDataFrame([(-1,)], "batch long"), f"{base}/batches", ["batch"])
    previous.write.mode("ignore").parquet(f"{base}/-1")

    def batch(hints: DataFrame, n: int) -> None:
        # read once, as a source of hints may be slow
        asked = cut(hints.where("path IS NOT NULL").groupBy("path").agg(F.bool_or("renamed").alias("renamed")))
        if asked.isEmpty():
            return
        before, now = latest(n), cut(current())
        covered, again = snapshot.hinted(before.select("path").union(now.select("path")), asked), None
        if "stable" in now.columns:
            torn = now.where(~F.col("stable")).select("path", F.lit(True).alias("_torn")).distinct()
            marked = cut(covered.join(torn, "path", "left"))
            again, covered = (marked.where(c).drop("_torn") for c in ("_torn", "_torn IS NULL"))
            now = now.drop("stable")
        else:
            covered = cut(covered)
        within = lambda d: d.join(covered.select("path"), "path", "left_semi")
        emit(snapshot.reconcile(within(before), within(now), covered, stored))
        rest = before.join(covered.select("path"), "path", "left_anti")
        known = before.select("path", F.col("id").alias("_id"))
        seen = within(now).join(known, "path", "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")
        write(rest.unionByName(seen), n)
        if again is not None and retry is not None and not again.isEmpty():
            retry(again)

    return batch


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """One of the driver's tables as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parquet*")
