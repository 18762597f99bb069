"""Metrics of binary classifiers. Input rows: label (0 or 1) and a score; empty inputs give null rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import THRESHOLD, bce_of_logit
from plumbline.operators.ranking import below_and_equal
from plumbline.operators.validate import require_empty

BINS = 15


def counts(predicted: Column, label: Column | None = None) -> list[Column]:
    """The aggregates tn, fp, fn and tp."""
    y = F.col("label") if label is None else label
    cell = lambda truth, guess, name: F.coalesce(F.sum(F.when((y == truth) & (predicted == F.lit(guess)), 1).otherwise(0)), F.lit(0)).cast("bigint").alias(name)
    return [cell(0, False, "tn"), cell(0, True, "fp"), cell(1, False, "fn"), cell(1, True, "tp")]


def rates(df: DataFrame) -> DataFrame:
    """Adds tnr, tpr and balanced_accuracy, null where a class is missing."""
    share = lambda part, rest: F.col(part) / F.nullif(F.col(part) + F.col(rest), F.lit(0))
    return df.withColumn("tnr", share("tn", "fp")).withColumn("tpr", share("tp", "fn")).withColumn("balanced_accuracy", (F.col("tnr") + F.col("tpr")) / F.lit(2.0))


def confusion(df: DataFrame, score: Column, threshold: float = THRESHOLD) -> DataFrame:
    """One row: counts and rates at an inclusive threshold."""
    return rates(df.agg(F.count("*").alias("count"), *counts(score >= F.lit(threshold))))


def frozen_threshold(threshold: float) -> float:
    """The threshold, if it is the one that results are published for."""
    if threshold != THRESHOLD:
        raise ValueError(f"the threshold is fixed at {THRESHOLD}")
    return threshold


def balanced_accuracy(df: DataFrame, score: Column, threshold: float = THRESHOLD) -> DataFrame:
    """One row: the balanced accuracy of a score. Bad labels, scores that are no numbers and a missing class are errors."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    finite = F.coalesce(~F.isnan(score) & (F.abs(score) < float("inf")), F.lit(False))
    require_empty(df.where(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)) | ~finite).select("label", score.alias("score")), "a label or score")
    found = confusion(df, score, threshold)
    require_empty(found.where("balanced_accuracy is null"), "both classes are needed")
    return found.select("balanced_accuracy")


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: the mean of ``value`` weighted by ``weight``; null if there is no weight."""
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight).cast("double"), F.lit(0.0))).alias("mean"))


def by_source(df: DataFrame, score: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and rates per source; where a source lacks a class, the balanced accuracy takes the overall rate for it.

    One pass: the overall counts are sums of the sources' counts.
    """
    each = rates(df.groupBy("source").agg(F.count("*").alias("count"), *counts(score >= F.lit(threshold))))
    overall = rates(each.agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])).select(F.col("tnr").alias("all_tnr"), F.col("tpr").alias("all_tpr"))
    filled = (F.coalesce("tnr", "all_tnr") + F.coalesce("tpr", "all_tpr")) / F.lit(2.0)
    return each.crossJoin(F.broadcast(overall)).withColumn("balanced_accuracy", filled).drop("all_tnr", "all_tpr")  # one row


def average_ranks(df: DataFrame, score: str) -> DataFrame:
    """(score, ties, average_rank): the mean 1-based rank of each distinct score."""
    at = below_and_equal(df.select(score, F.lit(1).cast("bigint").alias("w")), score, "w")
    return at.select(score, F.col("equal").cast("bigint").alias("ties"), (F.col("below") + (F.col("equal") + 1) / F.lit(2.0)).alias("average_rank"))


def auc(df: DataFrame, score: str) -> DataFrame:
    """One row: the share of (positive, negative) pairs in order, ties counting half; null if a class is missing."""
    per = df.groupBy(score).agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("neg"))
    under = below_and_equal(df.select(score, F.when(F.col("label") == 0, 1).otherwise(0).cast("bigint").alias("w")), score, "w").select(score, "below")
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0)))
    return per.join(under, score).agg((won / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"))


def cross_entropy(df: DataFrame, logit: Column) -> Column:
    return F.avg(bce_of_logit(logit, F.col("label").cast("double")))


def reliability(df: DataFrame, probability: Column, bins: int = BINS) -> DataFrame:
    """(bin, n, mean_probability, mean_label) of the non-empty equal-width bins; 1.0 falls in the last."""
    at = F.least(F.floor(probability * bins), F.lit(bins - 1)).cast("bigint").alias("bin")
    return df.groupBy(at).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col("label").cast("double")).alias("mean_label"))


def calibration_error(df: DataFrame, probability: Column, bins: int = BINS) -> DataFrame:
    """One row: the expected calibration error."""
    gap = F.abs(F.col("mean_probability") - F.col("mean_label")) * F.col("n")
    return reliability(df, probability, bins).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def accuracy(probability: Column, threshold: float = THRESHOLD) -> Column:
    return F.avg(((probability >= threshold).cast("int") == F.col("label")).cast("double"))
