"""Approximate search: product codes of what is left of a vector in its cell, and exact ranking of the best.

A vector is kept as the number of its nearest cell centre and, for each stretch of its
dimensions, the number of the nearest of 256 codewords of what remains: a byte a stretch.
A search reads codes alone, of the cells that a question probes; the ``rerank`` best of
them by their codes are looked up and ranked by their own vectors. So ties and scores are
those of exact search, and a question reads a bounded number of vectors.

Centres and codewords are fitted on ``SAMPLE`` vectors in expectation; every vector is
coded. Codes and questions meet in groups of a cell, a chunk of it and a block of the
questions that probe it, so that neither a large cell nor many questions fill a task.

Defined results
    null vectors, or of another width     not in the index, no hits
    dead slots                            left out before anything is ranked
    fewer live vectors than k             all of them
    no vectors or no questions            no hits
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.vectors import as_doubles, dot
from marginalia.operators.search import scored, topk
from marginalia.session import chosen, cut

SAMPLE, ROUNDS, CODEWORDS = 20_000, 12, 256
#: Questions that tell how many vectors the others must read, and the share of their exact answers that has to be among those.
TOLD_BY, SHARE = 256, 0.98
#: Codes and questions of a group: what one task holds at a time.
CHUNK, BLOCK = 32_768, 2_048


@dataclass
class Codebook:
    """``centres`` (cells, d), and for each stretch of dimensions ``(lo, hi, words)``."""

    centres: np.ndarray
    stretches: list[tuple[int, int, np.ndarray]]

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self.centres[cell].copy()
        for j, (lo, hi, words) in enumerate(self.stretches):
            out[:, lo:hi] += words[codes[:, j]]
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        return cell, np.stack([nearest(rest[:, lo:hi], words) for lo, hi, words in self.stretches], axis=1).astype(np.uint8)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row, of equals the first."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[k : k + 4096] @ centres.T, axis=1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` centres of the rows of ``x`` after ROUNDS rounds; a centre that nothing is near to stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(ROUNDS):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _width(vectors: DataFrame) -> int:
    """The most frequent width of a vector, of equals the smaller."""
    row = vectors.where("vector IS NOT NULL").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row.d if row else 0


def fit(vectors: DataFrame, cells: int | None = None, stretches: int = 16, seed: int = 7) -> Codebook | None:
    """A codebook from a bounded sample of ``vectors(segment, slot, vector)``; as many cells as the root of their number, 4,096 at most."""
    d, n = _width(vectors), vectors.count()
    if not d:
        return None
    whole = vectors.where(F.size("vector") == d)
    if n > SAMPLE:
        whole = whole.where(chosen(F.xxhash64("segment", "slot", F.lit(seed)), SAMPLE, n))
    # twice the sample at the most, whatever the ids
    got = whole.select(as_doubles(F.col("vector")).alias("v")).orderBy(F.xxhash64("v")).limit(2 * SAMPLE).toPandas()
    if not len(got):
        return None
    x = np.array(got["v"].tolist(), np.float64)
    centres = means(x, cells or int(min(max(n**0.5, 1), 4096)), seed)
    rest = x - centres[nearest(x, centres)]
    edges = np.linspace(0, d, min(stretches, d) + 1).astype(int)
    return Codebook(centres, [(lo, hi, means(rest[:, lo:hi], CODEWORDS, seed + 1 + j)) for j, (lo, hi) in enumerate(zip(edges.tolist(), edges[1:].tolist()))])


def build(vectors: DataFrame, book: Codebook | None) -> DataFrame:
    """``segment, slot, cell, codes``: a byte a stretch; written partitioned by cell it prunes files too."""
    if book is None:
        return vectors.limit(0).select("segment", "slot", F.lit(0).alias("cell"), F.lit(b"").alias("codes"))
    book = vectors.sparkSession.sparkContext.broadcast(book)
    kinds = dict(vectors.dtypes)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell, codes = book.value.encode(np.array(batch["v"].tolist(), np.float64))
                yield pd.DataFrame({"segment": batch["segment"], "slot": batch["slot"], "cell": cell.astype(np.int32), "codes": [c.tobytes() for c in codes]})

    usable = vectors.where(F.size("vector") == book.value.width).select("segment", "slot", as_doubles(F.col("vector")).alias("v"))
    return usable.mapInPandas(coded, f"segment {kinds['segment']}, slot {kinds['slot']}, cell int, codes binary")


def _probes(queries: DataFrame, book, probes: int) -> DataFrame:
    """``q, v, cell``: each question once for each cell it probes."""
    kinds = dict(queries.dtypes)

    def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                scores = np.array(batch["v"].tolist(), np.float64) @ book.value.centres.T
                yield batch.assign(cells=list(np.argsort(-scores, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    usable = queries.where(F.size("qv") == book.value.width).select("q", as_doubles(F.col("qv")).alias("v"))
    return usable.mapInPandas(probed, f"q {kinds['q']}, v array<double>, cells array<int>").select("q", "v", F.explode("cells").alias("cell"))


def candidates(index: DataFrame, queries: DataFrame, book: Codebook, probes: int, rerank: int) -> DataFrame:
    """``q, segment, slot, score, rk``: the ``rerank`` best of each question by their codes."""
    shared = index.sparkSession.sparkContext.broadcast(book)
    asked = _probes(queries, shared, probes)
    sizes = lambda rows, most, name: rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    # a row a cell, 4,096 at most
    parts = F.broadcast(sizes(index, CHUNK, "chunks").join(sizes(asked, BLOCK, "blocks"), "cell"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    codes = index.join(parts, "cell").withColumn("chunk", F.pmod(F.xxhash64("segment", "slot"), F.col("chunks")).cast("int")).withColumn("block", spread("blocks"))
    questions = asked.join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).withColumn("chunk", spread("chunks"))
    kinds, key = dict(index.dtypes) | dict(queries.dtypes), ["cell", "chunk", "block"]

    def best(codes: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(codes) and len(questions):
            code = np.frombuffer(b"".join(codes["codes"]), np.uint8).reshape(len(codes), -1)
            x = shared.value.decode(codes["cell"].to_numpy(), code)
            for k in range(0, len(questions), 256):
                some = questions.iloc[k : k + 256]
                scores = np.array(some["v"].tolist(), np.float64) @ x.T
                n = min(rerank, len(x))
                top = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                at = top.ravel()
                out.append(pd.DataFrame({"q": np.repeat(some["q"].to_numpy(), n), "segment": codes["segment"].to_numpy()[at], "slot": codes["slot"].to_numpy()[at], "score": np.take_along_axis(scores, top, axis=1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame(columns=["q", "segment", "slot", "score"])

    schema = f"q {kinds['q']}, segment {kinds['segment']}, slot {kinds['slot']}, score double"
    found = codes.select(*key, "segment", "slot", "codes").groupBy(*key).cogroup(questions.select(*key, "q", "v").groupBy(*key)).applyInPandas(best, schema)
    return topk(found, rerank)


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, book: Codebook | None, probes: int, k: int, rerank: int = 100, dead: DataFrame | None = None) -> DataFrame:
    """``q, segment, slot, score, rk`` of ``queries(q, qv)``: exact scores of the best by codes, ``dead(segment, slot)`` left out."""
    if book is None:
        return topk(vectors.limit(0).crossJoin(queries.limit(0)).select("q", "segment", "slot", F.lit(0.0).alias("score")), k)
    live = index if dead is None else index.join(dead.select("segment", "slot").distinct(), ["segment", "slot"], "left_anti")
    read = candidates(live, queries, book, probes, max(k, rerank)).select("q", "segment", "slot")
    own, asked = vectors.select("segment", "slot", "vector"), queries.select("q", "qv")
    score = dot(as_doubles(F.col("vector")), as_doubles(F.col("qv"))).alias("score")
    return topk(read.join(own, ["segment", "slot"]).join(asked, "q").select("q", "segment", "slot", score), k)


def settled(index: DataFrame, vectors: DataFrame, queries: DataFrame, book: Codebook | None, probes: int, k: int, rerank: int) -> tuple[int, int]:
    """``probes, rerank`` with which SHARE of the exact answers is found, by TOLD_BY of the questions in expectation; not less than is given.

    How far down by its codes an answer may lie grows with the table. The places of the exact
    answers of a few questions say it, and where cells that are not probed keep answers away, all are.
    """
    n = vectors.count()
    if book is None or rerank >= n:
        return probes, rerank
    asked = queries.where(F.size("qv") == book.width)
    asked = cut(asked.where(chosen(F.xxhash64("q"), TOLD_BY, asked.count())))
    exact = cut(topk(scored(vectors, asked, k), k).select("q", "segment", "slot"))
    wanted, cells = exact.count(), len(book.centres)
    for tried, most in ((probes, max(8 * rerank, n // 10)), (cells, n)):
        ranks, read = 8 * rerank, 0
        while read < most:
            read = min(ranks, most)
            places = candidates(index, asked, book, tried, read).join(exact, ["q", "segment", "slot"], "left_semi").select("rk")
            found = sorted(r.rk for r in places.collect())  # k places a question
            needed = math.ceil(wanted * SHARE)
            if len(found) >= needed:
                return tried, max(rerank, found[needed - 1] if needed else 0)
            ranks *= 8
    return cells, n
