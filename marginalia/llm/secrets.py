"""Secret scans, in DataFrame operations only: fixed patterns, and a test for randomness.

Two Markov models of characters are trained from labelled samples, one of random
strings and one of ordinary identifiers. A long token is a secret where the random
model explains it better: the log-likelihood ratio, a sum over its pairs of
neighbouring characters, is over a threshold for each pair. The threshold is chosen
on samples that the models have not seen. These spans add to those of the fixed
patterns and never replace one.

Samples come from all documents: every distinct word that the fixed patterns leave
is an ordinary identifier, every distinct string that they find a secret, and
strings of digests are secrets too. The models are a table over pairs of an
alphabet's characters; its counts are aggregated by Spark and its few thousand cells
travel as a constant, so a scan is one narrow projection without a shuffle. Built-in
functions give no positions of matches; they follow from the pieces between them, as
each piece and match has a length. Folds over the matches of a text go block by
block, so that a text of a million matches takes a million steps. The dear
expressions run only for texts in which the pattern occurs.

Defined results
    null or empty text   no spans
    repeated rows        each has its spans
    positions            in code points, the end exclusive
    overlap              base spans of different kinds may overlap; a span of the
                         method that overlaps a base span is left out
    very long texts      taken whole, in time linear in their length and matches
    no samples           the ratio is 0 everywhere and the method adds nothing
    other columns        carried through; clashing names are replaced
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import cut

#: Kinds in order, their patterns, the group whose length counts, and its least length.
BASE = (
    (
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Kind of the spans that the models add, and what they look at.
RANDOM, CANDIDATE = "random", r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Random strings for training and as many for choosing the threshold; matches that a fold takes in a block.
RANDOM_STRINGS, BLOCK = 6000, 256
#: The share of ordinary identifiers that may be taken for secrets, and the least threshold for a pair of characters.
FALSE_SHARE, LEAST_MEAN, STEP = 0.0005, 0.05, 0.01
SPAN = "array<struct<start:int,end:int,value:string>>"


def folded(items: Column, carried: dict[str, Column], step) -> Column:
    """Fold ``items`` from left to right; ``step(state, item)`` gives a state: the ``carried`` values and ``found``, an array.

    A state's array is copied when it grows, so each block of items starts with an
    empty one and the arrays are joined at the end. ``items`` must be a column of its own.
    """
    none = F.expr(f"cast(array() as {SPAN})")
    fresh = lambda s: F.struct(*[(s[c] if s is not None else v).alias(c) for c, v in carried.items()], none.alias("found"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))

    def block(states: Column, i: Column) -> Column:
        part = F.slice(items, i * BLOCK + 1, F.lit(BLOCK))
        return F.array_append(states, F.aggregate(part, fresh(F.element_at(states, -1)), step))

    states = F.aggregate(blocks, F.array(fresh(None)), block)
    return F.when(F.size(items) > 0, F.flatten(F.transform(states, lambda s: s["found"]))).otherwise(none)


def pieces(text: Column, pattern: str, group: int) -> Column:
    """What lies between the matches, the matches and their group; null where there is none."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), 0).alias("value"),
        F.regexp_extract_all(text, F.lit(pattern), group).alias("own"),
    )
    return F.when(text.rlike(pattern), zipped)


def matches(zipped: Column, least: int) -> Column:
    """``start, end, value`` of the matches of ``pieces`` whose group has ``least`` characters or more."""

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        end = start + F.coalesce(F.length(m["value"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"))
        long_enough = F.coalesce(F.length(m["own"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(long_enough, F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    found = folded(zipped, {"at": F.lit(0)}, step)
    return F.when(zipped.isNotNull(), found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def apart(events: Column) -> Column:
    """Of sorted ``start, kind, end, value`` those of the last kind that overlap none of the others, in one sweep.

    The others may overlap each other. One of the last kind waits until something
    begins at or after its end; a last event past all ends lets the last one go.
    """

    def step(acc: Column, e: Column) -> Column:
        other = e["kind"] < len(BASE)
        waits = acc["from"] >= 0
        held = F.struct(acc["from"].alias("start"), acc["to"].alias("end"), acc["value"].alias("value"))
        hit = other & (e["start"] < acc["to"])
        free = ~other & (e["start"] >= acc["reach"])
        keep = other & ~hit
        return F.struct(
            F.when(other, F.greatest(acc["reach"], e["end"])).otherwise(acc["reach"]).alias("reach"),
            F.when(keep, acc["from"]).when(free, e["start"]).otherwise(F.lit(-1)).alias("from"),
            F.when(keep, acc["to"]).when(free, e["end"]).otherwise(F.lit(-1)).alias("to"),
            F.when(keep, acc["value"]).when(free, e["value"]).otherwise(F.lit("")).alias("value"),
            F.when(~other & waits, F.array_append(acc["found"], held)).otherwise(acc["found"]).alias("found"),
        )

    return folded(events, {"reach": F.lit(0), "from": F.lit(-1), "to": F.lit(-1), "value": F.lit("")}, step)


def pairs(value: Column) -> Column:
    """Places in the table of all neighbouring characters; characters outside the alphabet are one."""
    at = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    n = F.size(at) - 1
    cells = F.zip_with(F.slice(at, 1, n), F.slice(at, 2, n), lambda a, b: a * SIZE + b)
    return F.when(F.length(value) > 1, cells).otherwise(F.expr("cast(array() as array<int>)"))


@dataclass(frozen=True)
class CharacterModels:
    """Log-likelihood ratios of character pairs, row by row of the first character, and the least ratio a pair of a secret."""

    ratios: tuple[float, ...]
    threshold: float = 0.35

    def ratio(self, value: Column) -> Column:
        """Random against ordinary, of a whole string."""
        table = F.split(F.lit(",".join(f"{r:.6f}" for r in self.ratios)), ",").cast("array<double>")
        return F.aggregate(pairs(value), F.lit(0.0), lambda acc, c: acc + F.element_at(table, c + 1))


def train(samples: DataFrame) -> CharacterModels:
    """From ``samples(value, secret)``: one model per label, smoothed, and their ratio."""
    cells = samples.where("value IS NOT NULL AND secret IS NOT NULL").select(
        F.col("secret").cast("boolean").alias("secret"), F.explode(pairs(F.col("value"))).alias("cell")
    )
    # at most two rows for each cell of the table
    counted = cells.groupBy("secret", "cell").count().collect()
    if len({r["secret"] for r in counted}) < 2:
        return CharacterModels((0.0,) * (SIZE * SIZE))
    logs: dict[bool, list[float]] = {}
    for label in (True, False):
        n = [0.5] * (SIZE * SIZE)
        for r in counted:
            if r["secret"] == label:
                n[r["cell"]] += r["count"]
        totals = [sum(n[i * SIZE : (i + 1) * SIZE]) for i in range(SIZE)]
        logs[label] = [math.log(n[c] / totals[c // SIZE]) for c in range(SIZE * SIZE)]
    return CharacterModels(tuple(a - b for a, b in zip(logs[True], logs[False])))


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS, first: int = 0) -> DataFrame:
    """Labelled samples of random strings: digests as hex, base 64 and upper-case letters with digits."""
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    kinds = [
        digest,
        F.substring(F.base64(F.unhex(digest)), 1, 40),
        F.translate(F.substring(F.base64(F.unhex(digest)), 1, 24), "+/=", "xyz"),
        F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)),
    ]
    values = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    return spark.range(first, first + n).select(values.alias("value"), F.lit(True).alias("secret"))


def unseen(value: Column) -> Column:
    """The third of all samples that no model is trained on."""
    return F.pmod(F.crc32(value.cast("binary")), F.lit(3)) == 1


def _rest(text_col: str) -> Column:
    """A text without what the fixed patterns match."""
    rest = F.coalesce(F.col(text_col), F.lit(""))
    for _, pattern, _, _ in BASE:
        rest = F.regexp_replace(rest, pattern, " ")
    return rest


def samples_of(docs: DataFrame, text_col: str) -> DataFrame:
    """Labelled samples of a corpus, each once: what the fixed patterns find, and the words that remain."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign, hexes = BASE[0][1], BASE[2][1]
    found = F.filter(F.concat(F.regexp_extract_all(text, F.lit(assign), 2), F.regexp_extract_all(text, F.lit(hexes), 0)), lambda v: F.length(v) >= 16)
    words = F.regexp_extract_all(_rest(text_col), F.lit(r"[A-Za-z0-9_-]{6,}"), 0)
    label = lambda values, flag: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(flag).alias("secret")))
    both = docs.select(F.explode(F.concat(label(found, True), label(words, False))).alias("s"))
    return both.select("s.value", "s.secret").distinct()


def identifiers(words: DataFrame) -> DataFrame:
    """``value``: ordinary identifiers as long as secrets are, of about three of the distinct ``words(value)`` each.

    Words meet by a hash in as many slots as a third of their number, so a slot holds a few.
    """
    slots = max(words.count() // 3, 1)
    slot = F.pmod(F.xxhash64("value", F.lit("slot")), F.lit(slots))
    return words.groupBy(slot.alias("slot")).agg(F.array_join(F.sort_array(F.collect_list("value")), "_").alias("value")).select("value")


def calibrated(models: CharacterModels, secret: DataFrame, ordinary: DataFrame) -> tuple[CharacterModels, dict[str, float]]:
    """The models with the least threshold that FALSE_SHARE of the ``ordinary(value)`` reach, and what it does on both.

    Both sides are unseen samples; their ratios are counted in steps of STEP, a bounded table.
    """
    both = secret.select("value", F.lit(True).alias("secret")).unionByName(ordinary.select("value", F.lit(False).alias("secret")))
    mean = models.ratio(F.col("value")) / F.length("value")
    bins = both.where(F.length("value") >= 20).groupBy("secret", F.floor(mean / STEP).alias("bin")).count().collect()
    counts = {flag: {r["bin"]: r["count"] for r in bins if r["secret"] == flag} for flag in (True, False)}
    total = {flag: max(sum(counts[flag].values()), 1) for flag in counts}
    over = lambda flag, at: sum(n for b, n in counts[flag].items() if b >= at)
    at = round(LEAST_MEAN / STEP)
    while over(False, at) > FALSE_SHARE * total[False]:
        at += 1
    told = {"threshold": at * STEP, "recall": over(True, at) / total[True], "false_share": over(False, at) / total[False]}
    return CharacterModels(models.ratios, at * STEP), told


def learnt(docs: DataFrame, text_col: str = "text") -> tuple[CharacterModels, dict[str, float]]:
    """Models and threshold from all documents; ``threshold, recall, false_share`` on unseen samples."""
    spark = docs.sparkSession
    found = cut(samples_of(docs, text_col))
    models = train(random_strings(spark).unionByName(found.where(~unseen(F.col("value")))))
    secret = random_strings(spark, first=RANDOM_STRINGS).unionByName(found.where(F.col("secret") & unseen(F.col("value"))))
    return calibrated(models, secret, identifiers(found.where(~F.col("secret") & unseen(F.col("value"))).select("value")))


def scan(docs: DataFrame, models: CharacterModels, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of ``start, kind, end`` in order.

    ``kind`` is a number, the place in the kinds of BASE, and after them the method's.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    spans = lambda found, kind: F.transform(
        found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    )
    rows = docs
    for k, (_, pattern, group, _) in enumerate([*BASE, (RANDOM, CANDIDATE, 0, 20)]):
        rows = rows.withColumn(f"__pieces{k}", pieces(text, pattern, group))
    base = [spans(matches(F.col(f"__pieces{k}"), least), k) for k, (_, _, _, least) in enumerate(BASE)]
    likely = F.filter(matches(F.col(f"__pieces{len(BASE)}"), 20), lambda s: models.ratio(s["value"]) >= models.threshold * (s["end"] - s["start"]))
    rows = rows.withColumn("base_spans", F.array_sort(F.concat(*base))).withColumn("__likely", likely)
    event = lambda start, kind, end, value: F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"), value.alias("value"))
    past = F.lit(2**31 - 1)
    events = F.array_sort(
        F.concat(
            F.transform("base_spans", lambda s: event(s["start"], s["kind"], s["end"], F.lit(""))),
            F.transform("__likely", lambda s: event(s["start"], F.lit(len(BASE)), s["end"], s["value"])),
            F.array(event(past, F.lit(len(BASE)), past, F.lit(""))),
        )
    )
    rows = rows.withColumn("__events", F.when((F.size("base_spans") > 0) & (F.size("__likely") > 0), events))
    alone = F.when(F.col("__events").isNotNull(), apart(F.col("__events"))).otherwise(F.col("__likely"))
    added = spans(alone, len(BASE))
    return rows.withColumn("all_spans", F.array_sort(F.concat("base_spans", added))).select(*keep, "base_spans", "all_spans")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in [*(b[0] for b in BASE), RANDOM]])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
