"""Phrase collocations by contiguous pattern growth over projected occurrence pointers.

Words are counted first; those that occur ``min_count`` times are the prefixes that may
grow. Each of their occurrences is a pointer to the words that follow in its piece, up to
the longest phrase asked for and only as long as each pair of neighbours may be frequent.
Pointers that see the same words travel as one with a weight, so a passage that thousands
of documents share costs a row a task. All pointers of a prefix go to one task, which
extends the prefix to the right, depth first, each time with the pointers that agree.

A prefix with more than ``TASK`` occurrences is not one task: its pointers are dealt by the
second and third word, so every phrase of three words or more is still grown whole in one
place, and only counts of two-word phrases are parts, which a sum puts together. How many
parts a prefix has, and whether it is frequent at all, is looked up in a table of ``SLOTS``
sums by hash, and whether a pair may be frequent in ``BITS`` bits by its hash: both of fixed
size and never too low, so a collision costs rows and no result.

Defined results
    null or empty text   no words
    null language        ``und``
    case                 A-Z only is lowered
    ties                 by score, then count, then the phrase in byte order; of cuts that
                         score alike the first counts
    repeated rows        each row's occurrences count; null and repeated ids don't matter
    long texts           read whole; cut where a piece ends, so that memory follows pieces
    empty table          an empty result
    other columns        not read
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import bounded_batches, cut

#: What ends a piece, and what separates words inside one.
PIECE_ENDS, WORD_GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: One byte of the above stands for all ends of pieces once a text is read.
END = b"."
#: Occurrences of a prefix, and pointers of a group, that a task is meant for: a megabyte or two. Each part of a
#: prefix is a row of each task that reads texts, so parts grow with the input twice: there are few for it.
TASK = 64_000
SLOTS, BITS = 1 << 22, 1 << 26
#: Hashes by which pairs are counted: few enough to travel in five bytes.
PAIRS = 1 << 36
#: Bytes of a text split at once, words that a worker remembers and positions it sums up before it hands them on.
SEGMENT, REMEMBERED, PENDING = 1 << 20, 300_000, 2_000_000
#: Continuations that a worker puts into words at a time.
LINES = 50_000
#: Places where the best of a language are chosen first.
SALTS = 64
#: An odd number that spreads the hash of a word over 64 bits.
SPREAD = np.uint64(0x9E3779B97F4A7C15)

_READ = bytes.maketrans(
    PIECE_ENDS + WORD_GAPS + bytes(range(65, 91)), END * len(PIECE_ENDS) + b" " * len(WORD_GAPS) + bytes(range(97, 123))
)


def tokens(text: bytes, segment: int = SEGMENT) -> Iterator[list[bytes]]:
    """The words of ``text`` with END wherever a piece ends, a bounded stretch of pieces at a time."""
    read, at = text.translate(_READ), 0
    while at < len(read):
        to = read.find(END, at + segment) + 1 or len(read)
        yield read[at:to].replace(END, b" . ").split()
        at = to


def slot(lang: bytes, word: bytes, slots: int) -> int:
    return zlib.crc32(lang + b"\x00" + word) % slots


def _slot(lang: Column, word: Column) -> Column:
    """The same as a column."""
    both = F.concat(F.encode(lang, "UTF-8"), F.unhex(F.lit("00")), F.encode(word, "UTF-8"))
    return F.pmod(F.crc32(both), F.lit(SLOTS))


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, word, n``: how often each word occurs, added up in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(END, None)
                words = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(words)), words, pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                for part in tokens(text):
                    held.setdefault(lang, Counter()).update(part)
            if sum(map(len, held.values())) > REMEMBERED:
                yield from rows()
        yield from rows()

    found = _texts(docs, text_col, lang_col).mapInArrow(counted, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def parts_by_slot(frequent: DataFrame) -> np.ndarray:
    """For each slot how many parts its prefixes are dealt to; 0 where no frequent word is. SLOTS entries at any size."""
    sums = frequent.groupBy(_slot(F.col("lang"), F.col("word")).cast("int").alias("slot")).agg(F.ceil(F.sum("n") / TASK).cast("int").alias("parts"))
    got = sums.toArrow()
    table = np.zeros(SLOTS, np.int32)
    table[got["slot"].to_numpy()] = got["parts"].to_numpy()
    return table


class _Vocabulary:
    """The words a worker has met in a language: a number for each frequent one, -1 for the others and for the end of a piece."""

    def __init__(self, lang: str, shares: np.ndarray) -> None:
        self.code, self.shares = lang.encode(), shares
        self.index: dict[bytes, int] = {END: -1}
        self.names: list[bytes] = []
        self.slots: list[int] = []
        self.hashes: list[int] = []

    def numbers(self, found: list[bytes]) -> np.ndarray:
        for word in {*found}.difference(self.index):
            at, self.index[word] = slot(self.code, word, len(self.shares)), -1
            if self.shares[at]:
                self.index[word] = len(self.names)
                self.names.append(word)
                self.slots.append(at)
                self.hashes.append(xxhash.xxh64_intdigest(self.code + b"\x00" + word))
        return np.array([*map(self.index.__getitem__, found), -1], np.int32)


def _in_bulk(batches: Iterator[pa.RecordBatch], shares: np.ndarray, most_waiting: int = PENDING, most_remembered: int = REMEMBERED) -> Iterator[tuple[str, _Vocabulary, np.ndarray]]:
    """The texts of a task as numbers of words, many texts of a language at a time."""
    known: dict[str, _Vocabulary] = {}
    pending: dict[str, list[np.ndarray]] = {}
    waiting = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            for found in tokens(text):
                words = known.get(lang) or known.setdefault(lang, _Vocabulary(lang, shares))
                pending.setdefault(lang, []).append(words.numbers(found))
                waiting += len(found)
                remembered = sum(len(v.index) for v in known.values())
                if waiting > most_waiting or remembered > most_remembered:
                    for each, stretches in pending.items():
                        yield each, known[each], np.concatenate(stretches)
                    pending, waiting = {}, 0
                    if remembered > most_remembered:
                        known = {}
    for each, stretches in pending.items():
        yield each, known[each], np.concatenate(stretches)


def _pairs(ids: np.ndarray, words: _Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Positions where two frequent words follow one another, and a hash of each two."""
    h = np.array(words.hashes, np.uint64)
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    first, second = h[ids[at]], h[ids[at + 1]]
    first *= SPREAD
    second >>= np.uint64(1)
    first ^= second
    first %= np.uint64(PAIRS)
    return at, first


def pair_bits(docs: DataFrame, parts: np.ndarray, min_count: int, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """BITS bits, set where the hash of a pair of neighbours falls that occurs ``min_count`` times."""
    table = docs.sparkSession.sparkContext.broadcast(parts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, ids in _in_bulk(batches, table.value):
            if words.names:
                pair, n = np.unique(_pairs(ids, words)[1], return_counts=True)
                for at in range(0, len(pair), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pair[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], ["pair", "n"])

    counts = _texts(docs, text_col, lang_col).mapInArrow(hashed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") >= min_count).select(F.pmod("pair", F.lit(BITS)).alias("bit"))
    word, bit = F.shiftright("bit", 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
    got = often.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _windows(ids: np.ndarray, goes_on: np.ndarray, width: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of two to ``width`` ids, each a row that ends in -1 from where it can't go on, and how often each occurs.

    ``goes_on`` says for each position whether the next word may follow it in a phrase.
    """
    padded, on = np.concatenate([ids, np.full(width, -1, ids.dtype)]), np.concatenate([goes_on, np.zeros(width, bool)])
    starts = np.flatnonzero(on)
    alive, columns = np.ones(len(starts), bool), [padded[starts]]
    key, bound = padded[starts].astype(np.int64), words + 1
    for k in range(1, width):
        alive = alive & on[starts + k - 1]
        now = np.where(alive, padded[starts + k], -1)
        columns.append(now)
        if bound * (words + 2) >= 1 << 62:
            distinct, key = np.unique(key, return_inverse=True)
            bound = len(distinct)
        key, bound = key * (words + 2) + now + 1, bound * (words + 2)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return np.stack([c[first] for c in columns], axis=1), count


def pointers(docs: DataFrame, parts: np.ndarray, bits: np.ndarray, max_words: int, groups: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``task, lang, prefix, split, seen``: what occurrences of frequent words see to their right.

    A row holds all that a task's texts have for a prefix: ``seen`` is a line for each different
    continuation, the words and, where it is more than one, after a tab how often they were seen.
    ``task``, of ``groups``, is a hash of the language and the prefix; where the prefix is
    ``split`` its continuations are dealt to several tasks by their first two words as well.
    """
    context = docs.sparkSession.sparkContext
    table, flags = context.broadcast(parts), context.broadcast(bits)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, bitmap = table.value, flags.value
        for lang, words, ids in _in_bulk(batches, shares):
            if not words.names:
                continue
            at, pair = _pairs(ids, words)
            pair %= np.uint64(64 * len(bitmap))
            goes_on = np.zeros(len(ids), bool)
            goes_on[at] = (bitmap[pair >> np.uint64(6)] >> (pair & np.uint64(63))) & np.uint64(1) == 1
            windows, count = _windows(ids, goes_on, max_words, len(words.names))
            names, hashes, slots = pa.array(words.names, pa.binary()), np.array(words.hashes, np.uint64), np.array(words.slots, np.int64)
            share = shares[slots[windows[:, 0]]].astype(np.uint64)
            third = hashes[windows[:, 2]] * (windows[:, 2] >= 0).astype(np.uint64) if max_words > 2 else np.uint64(0)
            tail = ((hashes[windows[:, 1]] * SPREAD ^ third) >> np.uint64(8)) % share
            task = (((hashes[windows[:, 0]] + tail * SPREAD) >> np.uint64(8)) % np.uint64(groups)).astype(np.int64)
            order = np.lexsort((task, windows[:, 0]))
            windows, count, task, split = windows[order], count[order], task[order], share[order] > 1
            first = np.flatnonzero(np.diff(windows[:, 0], prepend=-1) | np.diff(task, prepend=-1))
            edges = np.append(first, len(windows))
            # as many prefixes at a time as have about LINES continuations
            cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(windows), LINES)), len(first)))
            for low, high in zip(cuts.tolist(), cuts[1:].tolist()):
                at, ends, some = first[low:high], edges[low : high + 1], slice(edges[low], edges[high])
                column = lambda j: names.take(pa.array(windows[some, j], mask=windows[some, j] < 0))
                often = pa.array(count[some]).cast(pa.string()).cast(pa.binary())
                following = pc.binary_join_element_wise(*[column(j) for j in range(1, max_words)], b" ", null_handling="skip")
                lines = pc.if_else(pa.array(count[some] > 1), pc.binary_join_element_wise(following, often, b"\t"), following)
                seen = pc.binary_join(pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), lines), b"\n")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task[at]), pa.repeat(pa.scalar(lang), len(at)), names.take(pa.array(windows[at, 0])).cast(pa.string()), pa.array(split[at]), seen.cast(pa.string())],
                    ["task", "lang", "prefix", "split", "seen"],
                )

    return _texts(docs, text_col, lang_col).mapInArrow(projected, "task long, lang string, prefix string, split boolean, seen string")


def grow(prefix: str, length: int, seen: list[tuple[str, int]], min_count: int, whole: bool) -> Iterator[tuple[str, int, int]]:
    """``phrase, words, n`` of each frequent extension of ``prefix`` of ``length`` words, depth first.

    ``seen`` are the projected pointers: the words that follow the prefix from here on, with weights.
    Where the prefix is dealt to several tasks (``whole`` is false), its own extensions are
    parts of a count: they are returned and grown however few.
    """
    following: dict[str, list] = {}
    for words, n in seen:
        word, _, rest = words.partition(" ")
        at = following.get(word)
        if at is None:
            at = following[word] = [0, []]
        at[0] += n
        if rest:
            at[1].append((rest, n))
    for word, (n, projected) in following.items():
        if n >= min_count or not whole:
            longer = f"{prefix} {word}"
            yield longer, length + 1, n
            if projected:
                yield from grow(longer, length + 1, projected, min_count, True)


def frequent_phrases(docs: DataFrame, frequent: DataFrame, n_words: int, min_count: int = 10, max_words: int = 3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, phrase, words, n`` of all phrases of 2 to ``max_words`` words that occur ``min_count`` times.

    ``frequent(lang, word, n)`` are the words that do, ``n_words`` is how many words the texts have.
    """
    parts = parts_by_slot(frequent)
    rows = pointers(docs, parts, pair_bits(docs, parts, min_count, text_col, lang_col), max_words, max(64, -(-n_words // TASK)), text_col, lang_col)

    def task(group: pd.DataFrame) -> pd.DataFrame:
        prefixes: dict[tuple, list] = {}
        for lang, prefix, split, seen in zip(group["lang"], group["prefix"], group["split"], group["seen"]):
            at = prefixes.setdefault((lang, prefix, not split), [])
            for line in seen.split("\n"):
                words, _, n = line.partition("\t")
                at.append((words, int(n) if n else 1))
        out = [(lang, *found) for (lang, prefix, whole), seen in prefixes.items() for found in grow(prefix, 1, seen, min_count, whole)]
        return pd.DataFrame(out, columns=["lang", "phrase", "words", "n"])

    grown = rows.groupBy("task").applyInPandas(task, "lang string, phrase string, words int, n long")
    return grown.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _cuts(candidates: DataFrame) -> DataFrame:
    """``lang, a, k, left, right`` for each way to cut a candidate after its first k words."""
    words = F.split("phrase", " ")
    at = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("w", words)
    join = lambda c: F.array_join(c, " ")
    return at.select("lang", F.col("n").alias("a"), "k", join(F.slice("w", F.lit(1), F.col("k"))).alias("left"), join(F.slice("w", F.col("k") + 1, F.size("w"))).alias("right"))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, max_words: int = 3, top: int = 2000, scale: int = 1_000_000, covered_pct: int = 50
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its two parts at the cut that scores
    lowest, ``n`` all words of the language, and the score ``scale * a * a / (l * r)`` without
    remainder. A phrase is left out where a longer candidate holds it and has ``covered_pct``
    percent of its occurrences.
    """
    bounded_batches(docs.sparkSession)
    often = F.when(F.col("n") >= min_count, F.col("word")).alias("word")
    # the rare words of a language are one row, without a word
    words = cut(word_counts(docs, text_col, lang_col).groupBy("lang", often).agg(F.sum("n").alias("n")))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = words.where("word IS NOT NULL")
    found = cut(frequent_phrases(docs, frequent, n_words, min_count, max_words, text_col, lang_col))

    counts = frequent.select("lang", F.col("word").alias("part"), "n").union(found.select("lang", F.col("phrase").alias("part"), "n"))
    side = lambda name, count: counts.select("lang", F.col("part").alias(name), F.col("n").alias(count))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    product = lambda a, b: (exact(a) * exact(b)).cast("decimal(38,0)")
    both = _cuts(found).join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    both = both.withColumn("square", (product("a", "a") * F.lit(scale).cast("decimal(19,0)")).cast("decimal(38,0)")).withColumn("both", product("l", "r"))
    scored = both.select("lang", F.concat_ws(" ", "left", "right").alias("phrase"), "a", F.struct(F.expr("square div both").cast("long").alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    w = F.split("phrase", " ")
    inner = F.explode(
        F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(F.col("w"), i, m), " "))))
    )
    longer = found.where("words > 2").withColumn("w", w).select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_pct * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    chosen = best(best(flat, "lang", "salt").drop("rank"), "lang").join(totals, "lang")
    return chosen.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
