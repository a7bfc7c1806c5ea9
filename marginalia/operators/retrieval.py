"""From ranked hits to passages: floors, late lookup, demotion, score shape, status and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.search import topk

K, FLOOR, RELATIVE_FLOOR, OVERFETCH, NEAR_MISSES, LINK_DEMOTION = 6, 0.60, 0.55, 3, 3, 6000


def below_floor(score: Column, best: Column, floor: float = FLOOR, relative: float = RELATIVE_FLOOR) -> Column:
    """The relative floor is a share of the best score and says nothing where that is not positive."""
    return (score < floor) | ((best > 0) & (score < best * relative))


def resolve(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Look the text up after ranking; a range that no longer fits its document is unresolved.

    ``hits`` has ``object, start, end`` in bytes and ``documents`` ``object, text``.
    """
    found = hits.join(documents.select("object", F.encode("text", "UTF-8").alias("_bytes")), "object", "left")
    fits = F.col("_bytes").isNotNull() & (F.col("start") < F.col("end")) & (F.col("end") <= F.octet_length("_bytes"))
    # a range that cuts a character gives the replacement character there
    passage = F.make_valid_utf8(F.expr("cast(substring(_bytes, start + 1, end - start) AS string)"))
    return found.withColumn("resolved", fits).withColumn("text", F.when(fits, passage)).drop("_bytes")


def retrieve(
    pool: DataFrame,
    k: int = K,
    floor: float = FLOOR,
    relative: float = RELATIVE_FLOOR,
    demote: int = LINK_DEMOTION,
    misses: int = NEAR_MISSES,
) -> DataFrame:
    """Passages and near misses of each query out of its over-fetched ``pool``.

    ``pool`` has ``q, segment, slot, score, rk, resolved, link_ratio``. The result
    adds ``outcome`` (passage or near-miss) and ``place`` from 1. Reading stops at
    the k-th passage, so later misses are not among the near ones; the first
    link-heavy passage stands in where nothing else was kept.
    """
    order = Window.partitionBy("q").orderBy("rk")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("q")
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = (
        pool.withColumn("best", F.max("score").over(whole))
        .withColumn("miss", below_floor(F.col("score"), F.col("best"), floor, relative))
        .withColumn("clear", ~F.col("miss") & F.col("resolved") & (F.col("link_ratio") < demote))
        .withColumn("demoted", ~F.col("miss") & F.col("resolved") & (F.col("link_ratio") >= demote))
        .withColumn("kept_before", F.coalesce(F.sum(one(F.col("clear"))).over(before), F.lit(0)))
        .withColumn("miss_no", F.sum(one(F.col("miss"))).over(so_far))
        .withColumn("demoted_no", F.sum(one(F.col("demoted"))).over(so_far))
        .withColumn("kept_all", F.sum(one(F.col("clear"))).over(whole))
    )
    reading = F.col("kept_before") < k
    passage = F.col("clear") & reading
    stand_in = F.col("demoted") & (F.col("demoted_no") == 1) & (F.col("kept_all") == 0)
    near = F.col("miss") & reading & (F.col("miss_no") <= misses)
    return (
        rows.withColumn("outcome", F.when(passage | stand_in, "passage").when(near, "near-miss"))
        .where("outcome IS NOT NULL")
        .withColumn("place", F.when(passage, F.col("kept_before") + 1).when(stand_in, 1).otherwise(F.col("miss_no")))
        .drop("best", "miss", "clear", "demoted", "kept_before", "miss_no", "demoted_no", "kept_all")
    )


def retrieval_shape(pool: DataFrame) -> DataFrame:
    """Whether a query told its candidates apart: one row of score statistics per query."""
    stats = pool.groupBy("q").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.max("score").alias("best"),
        F.max(F.when(F.col("rk") == 2, F.col("score"))).alias("runner_up"),
        F.avg("score").alias("mean"),
        F.stddev_pop("score").alias("stddev"),
    )
    second = F.coalesce("runner_up", "best")
    standout = F.when(F.col("stddev") > 0, (F.col("best") - F.col("mean")) / F.col("stddev")).otherwise(F.lit(0.0))
    return stats.select(
        "q", "candidates", "best", second.alias("second_score"), "mean", "stddev", (F.col("best") - second).alias("gap"), standout.alias("standout")
    )


def score_spread(passages: DataFrame, least: float = 0.05) -> DataFrame:
    """Top minus bottom of what was returned, and whether the passages were barely told apart."""
    spread = passages.groupBy("q").agg((F.max("score") - F.min("score")).alias("spread"))
    return spread.withColumn("barely_apart", F.col("spread") < least)


def candidates(scores: DataFrame, k: int = K) -> DataFrame:
    return topk(scores, OVERFETCH * k)


def evaluation(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: hits at 1, 3 and 5, mean reciprocal rank, refusals and correct refusals.

    ``questions(q, expected)`` with a null ``expected`` where refusing is right;
    ``passages(q, place, text)``. A passage answers when it contains what is expected.
    """
    joined = questions.join(passages, "q", "left")
    hit = F.min(F.when(F.instr(F.col("text"), F.col("expected")) > 0, F.col("place")))
    each = joined.groupBy("q", "expected").agg(hit.alias("rank"), F.count("place").alias("given"))
    must_answer, refused = F.col("expected").isNotNull(), F.col("given") == 0
    within = lambda n: F.count_if(must_answer & (F.col("rank") <= n))
    return each.agg(
        F.count(F.lit(1)).alias("asked"),
        F.count_if(must_answer).alias("answerable"),
        within(1).alias("hit1"),
        within(3).alias("hit3"),
        within(5).alias("hit5"),
        (F.sum(F.when(must_answer, F.coalesce(1 / F.col("rank"), F.lit(0.0)))) / F.greatest(F.count_if(must_answer), F.lit(1))).alias("mrr"),
        F.count_if(refused).alias("refusals"),
        F.count_if(refused & ~must_answer).alias("correct_refusals"),
    )


def recall(approximate: DataFrame, exact: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: the share of exact hits found, by identity and by score."""
    worst = exact.groupBy("q").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("wanted"))
    same = approximate.select("q", "segment", "slot").join(exact.select("q", "segment", "slot", F.lit(1).alias("same")), ["q", "segment", "slot"], "left")
    by_id = same.groupBy("q").agg(F.count("same").alias("same"))
    good = approximate.join(worst, "q").where(F.col("score") >= F.col("worst") - tolerance).groupBy("q").agg(F.count(F.lit(1)).alias("as_good"))
    each = worst.join(by_id, "q", "left").join(good, "q", "left")
    return each.agg(
        (F.sum(F.coalesce("same", F.lit(0))) / F.sum("wanted")).alias("identity_recall"),
        (F.sum(F.least(F.coalesce("as_good", F.lit(0)), "wanted")) / F.sum("wanted")).alias("score_recall"),
    )


def verdict(reply: Column) -> Column:
    """``answer``, ``no-answer`` or ``absent``, from the first line of a model's reply."""
    first = F.upper(F.substring_index(F.regexp_replace(reply, r"^[ \n\r\t*#]+", ""), "\n", 1))
    return (
        F.when(first.contains("NO-ANSWER") | first.contains("NO ANSWER"), "no-answer")
        .when(first.contains("VERDICT") & first.contains("ANSWER"), "answer")
        .otherwise("absent")
    )


def without_verdict(reply: Column) -> Column:
    """The reply after its verdict line, where it has one."""
    trimmed = F.regexp_replace(reply, r"^[ \n\r\t*#]+", "")
    rest = F.regexp_replace(F.regexp_replace(trimmed, r"^[^\n]*", ""), r"^[\n\r]+", "")
    return F.when(verdict(reply) == "absent", reply).otherwise(rest)


def citations(text: Column, passages: Column) -> Column:
    """Places cited as ``[n]``, from 0, once each, in order, and only of passages that exist."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,4})\]"), 1), lambda n: n.cast("int"))
    return F.array_sort(F.array_distinct(F.transform(F.filter(numbers, lambda n: (n >= 1) & (n <= passages)), lambda n: n - 1)))


def answer_status(
    retrieved: Column, passages: Column, has_generator: Column, reply: Column
) -> Column:
    """The status of an answer; ``reply`` is null where the generator failed."""
    said = verdict(reply)
    return (
        F.when(~retrieved, "retrieval-failed")
        .when(passages == 0, "no-passages")
        .when(~has_generator, "answered")
        .when(reply.isNull(), "generation-failed")
        .when(said != "answer", "no-answer-in-passages")
        .when(F.size(citations(without_verdict(reply), passages)) == 0, "ungrounded")
        .otherwise("answered")
    )


def prompt(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """``q, prompt``: the question and its passages, numbered from 1."""
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("text"))
    listed = passages.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("p"))
    body = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nPassages:\n"), F.array_join("p.line", "\n"))
    return questions.join(listed, "q").select("q", body.alias("prompt"))
