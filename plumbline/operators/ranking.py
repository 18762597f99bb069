"""Ranks and running sums that no single task computes alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def digest_rank(df: DataFrame, within: list[str], digest: str, ties: list[str], out: str = "rank") -> DataFrame:
    """Adds the 1-based place of each row of ``within`` by (digest, ties).

    The digest's first three hex digits cut each group into 4,096 slices of like size;
    counts of the slices give the places at which they begin, so only a slice is ordered
    in one task however large the group is.
    """
    sliced = df.withColumn("_slice", F.substring(digest, 1, 3))
    at = [*within, "_slice"]
    before = Window.partitionBy(*within).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*at).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = sliced.join(starts, at)
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(digest, *ties))
    return placed.withColumn(out, (F.col("_before") + inside).cast("bigint")).drop("_slice", "_before")


def below_and_equal(scored: DataFrame, score: str, weight: str, cuts: int = 256) -> DataFrame:
    """(score, equal, below): the weight at each distinct score and the weight below it.

    Rows are combined per score first; the scores are cut at quantiles, and sums per cut
    give where each begins.
    """
    per = scored.groupBy(score).agg(F.sum(weight).alias("equal"))
    shares = [(i + 1) / cuts for i in range(cuts - 1)]
    limits = sorted(set(scored.agg(F.percentile_approx(score, shares, 10_000).alias("c")).first()["c"] or []))
    bands = F.lit(0) if not limits else F.size(F.filter(F.array(*[F.lit(float(x)) for x in limits]), lambda x: x < F.col(score)))
    banded = per.withColumn("_band", bands)
    before = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    starts = banded.groupBy("_band").agg(F.sum("equal").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.coalesce(F.sum("equal").over(Window.partitionBy("_band").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return banded.withColumn("_inside", inside).join(F.broadcast(starts), "_band").select(score, "equal", (F.col("_before") + F.col("_inside")).alias("below"))
