"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A corpus is a folder with, for each range of ids, three flat files that can be
memory-mapped: the tokens, the offset of each document in them (one more than
there are documents) and the documents' ids. ``index.json`` names the integer
type and, for each part, its base: the tokens in all parts before it. The bases
are prefix sums over one count per part, the only thing that reaches the driver.

Each task writes under a name of its own attempt and renames when complete, so a
repeated or lost task leaves the same files. The folder must be one that every
executor mounts at the same place, as memory-mapping needs a real path.

Defined results
    null or empty text   only the end id
    repeated rows        each is a document; equal ids stand by a hash of the text
    null id              stands first and reads back as null
    empty table          an index without tokens, and no rows
    other columns        not kept: a token file holds ids only
"""

from __future__ import annotations

import json
import os
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm.pretokens import Memo, splitter
from marginalia.session import bounded_batches, shared_dir

#: The pattern by which byte-level tokenizers split text (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_ID = -(1 << 63)
PIECES, READ_ROWS = 600_000, 4096


class TextEncoder:
    """``text -> ids`` by the tokenizers library, as little-endian unsigned 32-bit integers.

    Where the file's pipeline treats each piece of a text apart (byte level, no
    normaliser), pieces that come again are answered from a bounded memo. A text
    that holds one of the tokenizer's added tokens, and every text of another
    kind of tokenizer, goes to the library whole.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = splitter(BYTE_LEVEL)
        self.pieces = Memo(self._ids, PIECES)

    def _ids(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece or any(a in text for a in self.added):
            return self._ids(text)
        self.pieces.trim()
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


_ENCODERS: dict[int, TextEncoder] = {}


def encoder(definition: str) -> TextEncoder:
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(definition)
    return _ENCODERS[key]


def local_path(folder: str) -> str:
    where = urlparse(folder)
    if where.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped and need a mounted folder, not {folder}")
    return where.path


def new_folder(spark: SparkSession) -> str:
    return os.path.join(local_path(shared_dir(spark)), f"tokens-{uuid.uuid4().hex}")


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    parts: int | None = None,
) -> dict:
    """Encode ``docs`` into ``folder`` in ascending order of the id; returns the index."""
    spark, folder = docs.sparkSession, local_path(folder)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    size = Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True)
    kind = "<u2" if max(size - 1, end_id) < 1 << 16 else "<u4"
    held = spark.sparkContext.broadcast(definition)
    end = np.array([end_id], "<u4").tobytes()
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task = encoder(held.value), TaskContext.get()
        part = task.partitionId()
        stem = os.path.join(folder, f"part-{part:06d}")
        mine = f".attempt-{task.taskAttemptId()}"
        at, docs_here, kinds = 0, 0, (".tokens", ".offsets", ".ids")
        os.makedirs(folder, exist_ok=True)
        tokens, offsets, ids = (open(stem + k + mine, "wb") for k in kinds)
        with tokens, offsets, ids:
            for batch in batches:
                coded = [encode(t) + end for t in batch["text"]]
                tokens.write(np.frombuffer(b"".join(coded), "<u4").astype(kind).tobytes())
                lengths = np.array([len(c) // 4 for c in coded], "<i8")
                starts = at + np.cumsum(lengths) - lengths
                offsets.write(starts.astype("<i8").tobytes())
                ids.write(batch["id"].to_numpy("<i8").tobytes())
                at, docs_here = at + int(lengths.sum()), docs_here + len(coded)
            offsets.write(np.array([at], "<i8").tobytes())
        for k in kinds:
            os.replace(stem + k + mine, stem + k)
        yield pd.DataFrame({"part": [part], "docs": [docs_here], "tokens": [at]})

    bounded_batches(spark)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(known.alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))
    # one small row per part: their number is the number of files, not of documents
    counts = sorted(tuple(r) for r in rows.mapInPandas(write, "part long, docs long, tokens long").collect())
    base, index = 0, {"dtype": kind, "end_id": end_id, "parts": []}
    for part, n_docs, n_tokens in counts:
        index["parts"].append({"part": part, "docs": n_docs, "tokens": n_tokens, "base": base})
        base += n_tokens
    with open(os.path.join(folder, "index.json.new"), "w") as f:
        json.dump(index, f)
    os.replace(os.path.join(folder, "index.json.new"), os.path.join(folder, "index.json"))
    return index


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The corpus in ``folder``: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``."""
    folder = local_path(folder)
    with open(os.path.join(folder, "index.json")) as f:
        index = json.load(f)
    parts, kind = index["parts"], index["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                part = parts[k]
                if not part["docs"]:
                    continue
                stem = os.path.join(folder, f"part-{part['part']:06d}")
                tokens = np.memmap(stem + ".tokens", kind, "r")
                offsets, ids = np.memmap(stem + ".offsets", "<i8", "r"), np.memmap(stem + ".ids", "<i8", "r")
                for at in range(0, len(ids), READ_ROWS):
                    edge = np.array(offsets[at : at + READ_ROWS + 1])
                    texts = [np.asarray(tokens[a:b], "<u4") for a, b in zip(edge[:-1], edge[1:])]
                    own = pd.Series(np.array(ids[at : at + READ_ROWS])).astype("Int64")
                    out = {
                        "doc_id": own.mask(own == NO_ID),
                        "start": part["base"] + edge[:-1],
                        "n_tokens": np.diff(edge),
                        "ids_crc32": [zlib.crc32(t.tobytes()) for t in texts],
                    }
                    yield pd.DataFrame(out | ({"ids": [t.astype(np.int32) for t in texts]} if with_ids else {}))

    n = max(len(parts), 1)
    return spark.range(0, len(parts), 1, n).mapInPandas(read, schema)
