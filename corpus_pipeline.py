"""A training corpus from the documents table, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written and
read again as the next one's documents. All but the last return the columns of
documents; the last returns the ids that each document encodes to.

Defined results
    null or empty text   the empty text: scored like any other, one of them stays
    null id              never dropped for another's sake but where its text is an exact copy
    repeated ids         each row is a document of its own in every stage
    no usable labels     nothing can be ranked: every score is 0.5 and all documents stay
    empty table          an empty result
    near copies          pairs whose sets of five-word shingles are similar to 0.8 or
                         more, exactly; their classes are what such links reach
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, exact_dedup, mixing, quality, simhash
from marginalia.llm.queries import held_out
from marginalia.session import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking, learnt from the labels, puts above its threshold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by SimHash of five-word shingles."""
    return simhash.drop_similar(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(mixing.mix(docs)).select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether they decode to its text."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("restored"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: The fitted ranking and the merges of the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _forget(spark: SparkSession, folder: str) -> None:
    """Remove what no later stage reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder; a stage's table goes when the next one's is there."""
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            _forget(spark, f"{base}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
