"""Evaluation metrics. All start from small count tables, so hot classes cost nothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules
from ..functions.parsing import extract_score, judge_overall, parse_judge


def pair_by_key(truth: DataFrame, predicted: DataFrame, key: str = "item_id") -> DataFrame:
    """Truth next to prediction, by key and not by position; a missing prediction is null and counts as wrong."""
    return truth.join(predicted, key, "left")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("truth", "prediction").agg(F.count("*").alias("n"))


def per_class(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every label in truth or prediction.

    A missing prediction lowers the recall of its truth and is no label.
    """
    labels = F.array_compact(F.array_distinct(F.array("truth", "prediction")))
    sides = confusion_counts(df).select("n", "truth", "prediction", F.explode(labels).alias("label"))
    is_true, is_pred = F.col("truth") == F.col("label"), F.col("prediction").eqNullSafe(F.col("label"))
    counts = sides.groupBy("label").agg(
        F.sum(F.when(is_true & is_pred, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(is_pred, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(is_true, F.col("n")).otherwise(0)).alias("support"),
    )
    return counts.select(
        "label", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support", "tp",
    )


def classification(df: DataFrame) -> DataFrame:
    """Accuracy, macro precision, recall and F1, weighted F1: one row."""
    n = F.sum("support")
    return per_class(df).agg(
        ratio(F.sum("tp"), n).alias("accuracy"), F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"),
    )


def confusion_matrix(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """(truth, prediction, n) for every pair of labels, zeros included.

    The grid comes from the sorted label list; classes are few by nature.
    """
    counts = confusion_counts(df)
    if labels is None:
        both = F.array_union(F.collect_set("truth"), F.collect_set("prediction"))
        grid = counts.agg(F.array_sort(both).alias("labels"))
    else:
        grid = df.sparkSession.createDataFrame([(list(labels),)], "labels array<string>")
    grid = grid.select(F.explode("labels").alias("truth"), "labels").select("truth", F.explode("labels").alias("prediction"))
    return grid.join(counts, ["truth", "prediction"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def escalation_metrics(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of escalating, with both rates."""
    t, p = F.coalesce("truth", F.lit(False)), F.coalesce("prediction", F.lit(False))
    c = df.agg(
        F.count("*").alias("n"), F.count_if(t == p).alias("same"), F.count_if(t & p).alias("tp"),
        F.count_if(t).alias("t"), F.count_if(p).alias("p"),
    )
    tp, n = F.col("tp"), F.col("n")
    return c.select(
        ratio(F.col("same"), n).alias("accuracy"), ratio(tp, F.col("p")).alias("escalation_precision"),
        ratio(tp, F.col("t")).alias("escalation_recall"), ratio(2 * tp, F.col("p") + F.col("t")).alias("escalation_f1"),
        ratio(F.col("t"), n).alias("escalation_rate_true"), ratio(F.col("p"), n).alias("escalation_rate_predicted"),
    )


# ------------------------------------------------------------------ ratings


def scores_from_text(df: DataFrame, dimensions: Sequence[str] = rules.DIMENSIONS) -> DataFrame:
    """(item_id, dim, human, judge) from JSON rating texts, the overall score included."""
    h, j = F.try_parse_json("human"), F.try_parse_json("judge")
    names = [*dimensions, "overall_score"]
    cells = [
        F.struct(F.lit(d if d != "overall_score" else "overall").alias("dim"), extract_score(h, d).alias("human"), extract_score(j, d).alias("judge"))
        for d in names
    ]
    return df.select("item_id", F.explode(F.array(*cells)).alias("c")).select("item_id", "c.*")


def judge_scores(df: DataFrame, text_col: str) -> DataFrame:
    """(item_id, dim, score) from judge texts; unreadable ones rate 3 everywhere.

    A dimension given as an object without a score rates 3 as well, one given
    otherwise is left out.
    """
    return df.select("item_id", F.explode(parse_judge(F.col(text_col))).alias("dim", "score"))


def judge_overall_scores(df: DataFrame, text_col: str) -> DataFrame:
    return df.select("item_id", judge_overall(F.col(text_col)).alias("score")).filter(F.col("score").isNotNull())


def aggregate_judge(long: DataFrame, default: float = 3.0) -> DataFrame:
    """Mean, population deviation, minimum, maximum and count per dimension."""
    s = F.coalesce(F.col("score"), F.lit(default))
    return long.groupBy("dim").agg(
        F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"),
        F.count("*").alias("n"),
    )


def _correlation(x: str, y: str, n: str = "n") -> Column:
    """Weighted Pearson correlation of two columns; null when a side is constant."""
    w = F.sum(n)
    mx, my = F.sum(F.col(x) * F.col(n)) / w, F.sum(F.col(y) * F.col(n)) / w
    vx = F.sum(F.col(x) * F.col(x) * F.col(n)) / w - mx * mx
    vy = F.sum(F.col(y) * F.col(y) * F.col(n)) / w - my * my
    cov = F.sum(F.col(x) * F.col(y) * F.col(n)) / w - mx * my
    return F.when((vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(vx * vy))


def agreement(scores: DataFrame, min_pairs: int = 3) -> DataFrame:
    """Agreement of human and judge scores per dimension with at least `min_pairs` pairs.

    Works on the count table of (dimension, human, judge); rank correlation uses
    average ranks, which follow from the counts of each score.
    """
    table = (
        scores.filter(F.col("human").isNotNull() & F.col("judge").isNotNull())
        .groupBy("dim", "human", "judge").agg(F.count("*").alias("n"))
    )

    def ranks(side: str) -> DataFrame:
        below = Window.partitionBy("dim").orderBy(side).rowsBetween(Window.unboundedPreceding, -1)
        return table.groupBy("dim", side).agg(F.sum("n").alias("c")).select(
            "dim", side, (F.coalesce(F.sum("c").over(below), F.lit(0)) + (F.col("c") + 1) / 2.0).alias(f"{side}_rank")
        )

    ranked = table.join(ranks("human"), ["dim", "human"]).join(ranks("judge"), ["dim", "judge"])
    gap, n, total = F.abs(F.col("human") - F.col("judge")), F.col("n"), F.sum("n")
    return ranked.groupBy("dim").agg(
        (F.sum(F.when(gap == 0, n).otherwise(0)) / total).alias("exact_agreement"),
        (F.sum(F.when(gap <= 1, n).otherwise(0)) / total).alias("near_agreement"),
        (F.sum(gap * n) / total).alias("mae"),
        F.coalesce(_correlation("human", "judge"), F.lit(0.0)).alias("pearson_r"),
        _correlation("human_rank", "judge_rank").alias("spearman_r"),
        total.alias("n_samples"),
        (F.sum(F.col("human") * n) / total).alias("human_mean"),
        (F.sum(F.col("judge") * n) / total).alias("judge_mean"),
    ).filter(F.col("n_samples") >= min_pairs)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, f, m = 1.0, 0.0, 1.0, 0
    while True:
        if m == 0:
            step = 1.0
        elif m % 2 == 0:
            k = m // 2
            step = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            k = (m - 1) // 2
            step = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if m and abs(1 - c * d) < 1e-15:
            return front * (f - 1)
        m += 1


def two_sided_p(r: float, n: int) -> float:
    """p-value of a correlation r over n pairs, from Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3 or math.isnan(r):
        return math.nan
    # t^2 = r^2 df / (1 - r^2), so df / (df + t^2) is 1 - r^2
    return incomplete_beta((n - 2) / 2, 0.5, max(0.0, 1 - r * r))


def with_p_value(agreed: DataFrame) -> DataFrame:
    """Adds `spearman_p`; the input has one row per dimension."""
    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(a, int(b)) if not pd.isna(a) else math.nan for a, b in zip(r, n)])

    return agreed.withColumn("spearman_p", p("spearman_r", "n_samples"))


# -------------------------------------------------------------- comparisons


def compare_approaches(answers: DataFrame) -> DataFrame:
    """Mean confidence, escalation rate, reply length and similarity of the case answered from, of each `approach` (null without any)."""
    return answers.groupBy("approach").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("should_escalate").cast("int")).alias("escalation_rate"),
        F.avg(F.length(F.coalesce("reply", F.lit("")))).alias("mean_reply_chars"), F.avg("similarity").alias("mean_similarity"),
    )


def escalation_summary(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("n"), F.avg(F.col("should_escalate").cast("int")).alias("escalation_rate"),
        F.avg("escalation_score").alias("mean_score"),
    )
