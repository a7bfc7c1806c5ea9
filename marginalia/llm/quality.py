"""Quality classifier: Bradley-Terry pairwise ranking over text features.

Training pairs one document labelled good with one labelled bad and fits, by
logistic loss on the difference of their features, the weights under which the
good one wins. A weighted sum of features then ranks any document, and a quantile
of the ranks of the training documents, placed at the share of bad ones among
them, becomes the score 0.5.

Every labelled row is fitted on. Their features are dealt to blocks by a hash, with
copies of the rarer class where a block would have few, and a good and a bad document of
a block make a pair; ``PAIRS_PER_DOC`` says how many each of the commoner class is in. The
loss is minimised by Newton steps: tasks add up gradient and curvature of their blocks'
pairs, which are never written down, and the sums are of fixed size. What tells good from bad is learnt: the features are hashed byte n-grams of the whole text
and a few general shares of it, in an Arrow UDF, so scoring is one narrow projection
without a shuffle.

Defined results
    null text       counts as the empty text and gets a score
    null label      the row is not used for training
    repeated labels each labelled row counts; ties in rank are one rank
    one class only  nothing can be ranked: every score is 0.5
    empty table     an empty result
    other columns   carried through; clashing names are replaced
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.exact_dedup import gate, through
from marginalia.session import bounded_batches, cut

#: Pairs per document of the commoner class; documents of a block, and of its rarer class at the least, in expectation.
PAIRS_PER_DOC, BLOCK, RARER = 4, 128, 16
#: Newton steps at the most, the slope at which they end, and the rows that the sums of all tasks are added up in.
STEPS, FLAT, SUMS = 30, 1e-7, 16
#: Blocks of a task.
BLOCKS = 64
#: Buckets of byte n-grams, their length, and the regularisation of all weights.
BUCKETS, GRAM, RIDGE = 512, 3, 1e-3
SHAPE = ("letters", "capitals", "spaces", "digits", "marks", "repeats", "distinct", "word_bytes", "log_words")
WIDTH = len(SHAPE) + BUCKETS
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = CAPITALS.lower() + CAPITALS + bytes(range(128, 256))
_MIX = np.uint32(0x9E3779B1)


def shape(body: bytes) -> list[float]:
    """SHAPE of a whole text: shares of its bytes and of its words."""
    n, words = max(len(body), 1), body.split()
    n_words = max(len(words), 1)

    def share(of: bytes) -> float:
        return (len(body) - len(body.translate(None, of))) / n

    letters, spaces, digits = share(PLAIN), share(b" \n\t"), share(b"0123456789")
    return [
        letters,
        share(CAPITALS),
        spaces,
        digits,
        1 - letters - spaces - digits if body else 0.0,
        sum(map(eq, words, words[1:])) / n_words,
        len(set(words)) / n_words,
        min(n / n_words / 10, 3.0),
        math.log10(n_words) / 4,
    ]


def grams(body: bytes) -> np.ndarray:
    """Byte n-grams of a whole text in hashed buckets: roots of their shares, so that rare ones count."""
    x = np.frombuffer(body, np.uint8).astype(np.uint32)
    if len(x) < GRAM:
        return np.zeros(BUCKETS)
    code = np.zeros(len(x) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | x[k : len(x) - GRAM + 1 + k]
    code = (code * _MIX) >> np.uint32(16)
    return np.sqrt(np.bincount(code % BUCKETS, minlength=BUCKETS) / len(code))


def text_features(text: str | None) -> np.ndarray:
    """WIDTH numbers: the shape of a text and its n-grams."""
    body = (text or "").encode("utf-8", "surrogatepass")
    return np.concatenate((shape(body), grams(body)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def features(texts: pd.Series) -> pd.Series:
    return pd.Series([text_features(t).astype(np.float32) for t in texts], dtype=object)


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    """``_x``: the features as an array."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn("_x", features(F.col(text_col)))


@dataclass(frozen=True)
class Ranking:
    """A fitted model: weights of the features, the rank that scores 0.5, and the steepness there."""

    weights: tuple[float, ...]
    threshold: float
    scale: float = 1.0

    def rank(self, x: Column) -> Column:
        return F.aggregate(F.zip_with(x, F.lit(list(self.weights)), lambda a, w: a * w), F.lit(0.0), lambda t, a: t + a)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``_id, _y, _x``: the features of every document with a label; a label that is given twice counts once."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")
    ).distinct()
    # a bitmap of fixed size keeps the texts without a label where they are
    key = F.xxhash64("_id").alias("_key")
    some = through(docs.select(F.col(id_col).alias("_id"), text_col).select("*", key), gate(usable.select(key), "_key"), "_key")
    return cut(with_features(some, text_col).select("_id", "_x").join(usable, "_id"))


def blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``block, x, y, own``: the features, labels and first copies of a block's documents, a row a block."""
    n, rarer = max(-(-sum(counts.values()) // BLOCK), 1), min(counts, key=counts.__getitem__)
    copies = F.when(F.col("_y") == rarer, -(-RARER * n // counts[rarer])).otherwise(1)
    dealt = rows.select("_id", "_y", "_x", F.explode(F.sequence(F.lit(0), F.least(copies, F.lit(n)) - 1)).alias("_copy"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("_id", "_copy", F.lit("block")), F.lit(n)))

    def pack(rows: pa.Table) -> pa.Table:
        # in an order that does not depend on how rows came
        rows = rows.sort_by([("_id", "ascending"), ("_copy", "ascending"), ("_y", "ascending")])
        x = rows["_x"].combine_chunks().flatten().to_numpy().astype(np.float32)
        y, own = rows["_y"].to_numpy().astype(np.int8), (rows["_copy"].to_numpy() == 0).astype(np.int8)
        return pa.table({"block": rows["block"][:1], "x": [x.tobytes()], "y": [y.tobytes()], "own": [own.tobytes()]})

    packed = cut(dealt.groupBy("block").applyInArrow(pack, "block long, x binary, y binary, own binary"))
    # a task sends sums of fixed size however few blocks it has
    return packed.coalesce(max(-(-n // BLOCKS), 1))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k, x, y, own in zip(*(batch[c].to_pylist() for c in ("block", "x", "y", "own"))):
            yield k, np.frombuffer(x, np.float32).reshape(-1, WIDTH), np.frombuffer(y, np.int8), np.frombuffer(own, np.int8)


def differences(block: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features of a good document less those of a bad one, a row a pair; the same for a block each time."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.empty((0, WIDTH), np.float32)
    n = max(len(good), len(bad))
    met = np.random.default_rng(block).integers(0, min(len(good), len(bad)), PAIRS_PER_DOC * n)
    each = np.tile(np.arange(n), PAIRS_PER_DOC)
    return good[each] - bad[met] if len(good) == n else good[met] - bad[each]


def _sums(packed: DataFrame, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Pairs, and the sums over them of loss, gradient and curvature at the weights ``w``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, slope, curve = 0, 0.0, np.zeros(WIDTH), np.zeros((WIDTH, WIDTH))
        for k, x, y, _ in _read(batches):
            d = differences(k, x, y)
            z = d.astype(np.float64) @ w
            lost = 1 / (1 + np.exp(np.clip(z, -700, 700)))
            n, loss = n + len(d), loss + np.logaddexp(0, -z).sum()
            slope -= d.T.astype(np.float64) @ lost
            heavy = d * np.sqrt(lost * (1 - lost)).astype(np.float32)[:, None]
            curve += heavy.T @ heavy
        raw = np.concatenate(([n, loss], slope, curve.ravel())).tobytes()
        yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), "raw": pa.array([raw], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(r.as_py()) for r in rows["raw"])
        return pa.table({"raw": pa.array([total.tobytes()], pa.binary())})

    parts = packed.mapInArrow(task, "k int, raw binary").groupBy("k").applyInArrow(add, "raw binary").collect()
    total = sum((np.frombuffer(bytes(r.raw)) for r in parts), np.zeros(2 + WIDTH + WIDTH * WIDTH))
    return total[0], total[1], total[2 : 2 + WIDTH], total[2 + WIDTH :].reshape(WIDTH, WIDTH)


def _weights(packed: DataFrame) -> np.ndarray:
    """The weights of least mean loss and ridge, the ridge in units of each feature's spread."""
    w, step, least, ridge = np.zeros(WIDTH), np.zeros(WIDTH), math.inf, None
    for _ in range(STEPS):
        n, loss, slope, curve = _sums(packed, w)
        if not n:
            break
        ridge = 4 * RIDGE * np.diag(curve) / n if ridge is None else ridge
        now = loss / n + (ridge * w * w).sum() / 2
        if now > least + 1e-9:
            step = step / 2
            w = w - step
            continue
        least, down = now, slope / n + ridge * w
        if np.abs(down).max() < FLAT:
            break
        step = -np.linalg.solve(curve / n + np.diag(ridge + 1e-9), down)
        w = w + step
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Ranking:
    """Learn from all ``labels(id, label)``; the caller leaves held-out rows away."""
    rows = labelled(docs, labels, id_col, text_col, label_col)
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return Ranking((0.0,) * WIDTH, 0.0)
    packed = blocks(rows, counts)
    w = _weights(packed)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, _, own in _read(batches):
            yield pa.RecordBatch.from_pydict({"r": pa.array(x[own == 1].astype(np.float64) @ w)})

    bad = counts[0] / (counts[0] + counts[1])
    at = packed.mapInArrow(ranks, "r double").agg(
        F.expr(f"percentile_approx(r, array({max(bad - 0.005, 0.0)}, {min(bad + 0.005, 1.0)}), 10000)").alias("q")
    ).first()["q"]
    return Ranking(tuple(map(float, w)), (float(at[0]) + float(at[1])) / 2)


def score(docs: DataFrame, model: Ranking, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` and ``predicted``."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    weights, threshold, scale = np.array(model.weights), model.threshold, model.scale

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        x = np.array([text_features(t) for t in texts], np.float32).reshape(len(texts), len(weights)).astype(np.float64)
        return pd.Series(1 / (1 + np.exp(np.clip((threshold - x @ weights) * scale, -700, 700))))

    bounded_batches(docs.sparkSession)
    rows = docs.withColumn("score", scored(F.col(text_col))).select(*keep, "score")
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
