"""Chat formatting with prefix-target expansion, in DataFrame operations only.

A conversation becomes one text in which every turn stands between marks. Inside
roles and texts the characters that could form a mark are replaced by entities,
which also makes the text reversible: ``read_turns`` gives the turns back. Each
assistant turn is then an example of its own: all before it is context, its reply
alone is trainable. At rest an example is a span of the one text, so a conversation
of n turns takes space for n turns and not for all its prefixes; ``expand_examples``
cuts context and target out, a row at a time and without a shuffle, and ``read_back``
takes what is trainable from those rows.

A conversation's turns meet in one task, as its text must be one value; different
conversations spread over all tasks by their id.

Defined results
    null text or role   the empty one
    null id             a conversation of its own
    order               by turn, nulls first, then role and text; ties are alike
    repeated rows       each is a turn
    no assistant turn   formatted, without examples
    empty table         empty results
    other columns       not kept: the output is text and spans
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<turn role=", ">", "</turn>\n"
TURN = r"<turn role=([^>]*)>([^<]*)</turn>\n"
#: Character and entity; the first is replaced first and restored last.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
TRAINABLE = "assistant"


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, entity in ENTITIES:
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def unescape(text: Column) -> Column:
    out = text
    for plain, entity in reversed(ENTITIES):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, formatted, loss``: the text, and the spans of it that are trainable."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    turns = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    turns = (
        turns.withColumn("_head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE)))
        .withColumn("_body", escape(F.col("text")))
        .withColumn("_len", F.length("_head") + F.length("_body") + len(CLOSE))
        .withColumn("_no", F.row_number().over(order))
        .withColumn("_at", F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_len"))
    )
    start = F.col("_at") + F.length("_head")
    turns = turns.withColumn(
        "_loss", F.when(F.col("role") == TRAINABLE, F.struct(start.alias("start"), (start + F.length("_body")).alias("end")))
    )
    piece = F.struct("_no", F.concat("_head", "_body", F.lit(CLOSE)).alias("piece"), "_loss")
    return (
        turns.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(piece)).alias("p"))
        .select("conv_id", F.array_join("p.piece", "").alias("formatted"), F.array_compact("p._loss").alias("loss"))
    )


def expand_examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example, context, target``; only the target is trainable."""
    spans = formatted.select("conv_id", "formatted", F.posexplode("loss").alias("example", "s"))
    return spans.select(
        "conv_id",
        "example",
        F.expr("substring(formatted, 1, int(s.start))").alias("context"),
        F.expr("substring(formatted, int(s.start) + 1, int(s.end - s.start))").alias("target"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a text, as they were before: an array of ``role, text``."""
    pairs = F.arrays_zip(F.regexp_extract_all(formatted, F.lit(TURN), 1).alias("role"), F.regexp_extract_all(formatted, F.lit(TURN), 2).alias("text"))
    return F.transform(pairs, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, loss_text, examples, context_chars``: what the texts and their examples say.

    ``loss_text`` is all targets of a conversation, unescaped, in the order of its examples.
    """
    examples = expand_examples(formatted)
    target = F.struct("example", unescape(F.col("target")).alias("text"))
    told = examples.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(target)).alias("_t"), F.count(F.lit(1)).alias("examples"), F.sum(F.length("context")).alias("context_chars")
    )
    told = told.select(F.col("conv_id").alias("_c"), F.array_join("_t.text", "").alias("loss_text"), "examples", "context_chars")
    rows = formatted.withColumn("turns", read_turns(F.col("formatted"))).join(told, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("conv_id", "formatted", "turns", F.coalesce("loss_text", F.lit("")).alias("loss_text"), zero("examples"), zero("context_chars"))
