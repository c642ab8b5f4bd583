"""Scoring of answers: summaries, failure breakdowns, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Categories of questions.
CATEGORIES = {1: "multi_hop", 2: "temporal", 3: "open_domain", 4: "single_hop", 5: "adversarial_skip"}


def category_name(category: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    return F.when(category.isNull(), "unknown").otherwise(F.coalesce(F.element_at(names, category.cast("int")), F.concat(F.lit("category_"), category.cast("string"))))


def evidence_recall(expected: Column, found: Column, nothing: float | None = 1.0) -> Column:
    """Share of the expected ids that were found; `nothing` if none was expected."""
    wanted = F.array_distinct(expected)
    return F.when(F.size(wanted) == 0, F.lit(nothing).cast("double")).otherwise(F.size(F.array_intersect(wanted, found)) / F.size(wanted))


def summarize(items: DataFrame, group: str) -> DataFrame:
    """Overall and by group in one pass; accuracy over judged items only, null if there are none.

    items: skipped, judged, correct (booleans), exact_match, token_f1, evidence_recall (doubles, recall nullable).
    """
    scored = ~F.col("skipped")
    mean = lambda c: F.avg(F.when(scored, F.col(c)))
    return items.rollup(group).agg(
        F.grouping(group).cast("int").alias("overall"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(scored).alias("n_scored"),
        F.count_if(F.col("skipped")).alias("n_skipped"),
        F.count_if(scored & F.col("judged")).alias("n_judged"),
        F.avg(F.when(scored & F.col("judged"), F.col("correct").cast("double"))).alias("accuracy"),
        mean("exact_match").alias("exact_match"),
        mean("token_f1").alias("token_f1"),
        mean("evidence_recall").alias("evidence_recall"),
    )


def failure_reason() -> Column:
    """Why a scored item is not correct, in order of precedence; null for skipped and correct items."""
    return (
        F.when(F.col("skipped") | (F.col("judged") & F.col("correct")), None)
        .when(F.col("judge_error"), "judge_error")
        .when(~F.col("judged"), "unjudged")
        .when(F.col("unsupported"), "missing_evidence")
        .otherwise("wrong_answer")
    )


def failure_breakdown(items: DataFrame) -> DataFrame:
    return items.withColumn("reason", failure_reason()).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def run_agreement(records: DataFrame, item: str, verdict: str, answer: str) -> DataFrame:
    """Items that ran twice or more: whether verdicts agree, and whether non-empty answers do."""
    runs = records.groupBy(item).agg(
        F.count(F.lit(1)).alias("n_runs"),
        (F.countDistinct(verdict) <= 1).alias("same_verdict"),
        (F.countDistinct(F.when(F.col(answer) != "", F.col(answer))) <= 1).alias("same_answer"),
    )
    return runs.where("n_runs >= 2")


def recall_comparison(first: DataFrame, second: DataFrame, item: str) -> DataFrame:
    """Counters over items that both runs have: recall and correct in each."""
    both = first.select(item, F.col("recall").alias("r1"), F.col("correct").alias("c1")).join(second.select(item, F.col("recall").alias("r2"), F.col("correct").alias("c2")), item)
    return both.agg(
        F.count_if(F.col("r2") > F.col("r1")).alias("improved"),
        F.count_if(F.col("r2") == F.col("r1")).alias("same"),
        F.count_if(F.col("r2") < F.col("r1")).alias("worse"),
        F.count_if(F.col("c1") & F.col("c2")).alias("both_correct"),
        F.count_if(F.col("c1") & ~F.col("c2")).alias("only_first"),
        F.count_if(~F.col("c1") & F.col("c2")).alias("only_second"),
        F.count_if(~F.col("c1") & ~F.col("c2")).alias("both_wrong"),
    )


def token_f1_by_row(rows: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    """(key, f1): as text.token_f1, for texts of any length: tokens are counted by row, not compared with one another."""
    side = lambda c, i: rows.select(F.col(key), F.explode(X.answer_tokens(F.col(c))).alias("t"), F.lit(i).alias("r"))
    counts = side(reference, 1).unionByName(side(candidate, 0)).groupBy(key, "t").agg(F.sum("r").alias("in_r"), F.sum(1 - F.col("r")).alias("in_c"))
    sums = counts.groupBy(key).agg(F.sum(F.least("in_r", "in_c")).alias("shared"), F.sum("in_r").alias("n_r"), F.sum("in_c").alias("n_c"))
    f1 = F.when((F.col("n_r") == 0) | (F.col("n_c") == 0), (F.col("n_r") == F.col("n_c")).cast("double")).otherwise(F.lit(2.0) * F.col("shared") / (F.col("n_r") + F.col("n_c")))
    # a row without any token on either side says the same on both
    return rows.select(key).join(sums.select(key, f1.alias("f1")), key, "left").fillna(1.0, ["f1"])
