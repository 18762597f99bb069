"""Overlaps between training data and registered holdouts, and set differences.

All are equi-joins: nulls match nothing. Holdout sides are not forced into a broadcast;
Spark broadcasts them where their size allows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The training columns that each check compares with which holdout column, in order of precedence.
CHECKS = {"id": (("sample_id", "upstream_path"), "file_name"), "content": (("content_sha256", "upstream_sha256"), "content_sha256"), "provenance": (("provenance_group",), "provenance_group")}


def values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(value): the distinct non-null values of several columns, in one pass."""
    return df.select(F.explode(F.array(*columns)).alias("value")).where("value is not null").distinct()


def overlap(training: DataFrame, holdout: DataFrame, check: str) -> DataFrame:
    """(holdout_id, value): values of training that a holdout has."""
    columns, theirs = CHECKS[check]
    held = holdout.select("holdout_id", F.col(theirs).alias("value")).where("value is not null and value <> ''").distinct()
    return held.join(values(training, columns), "value").select("holdout_id", "value")


def prior_overlap(prior: DataFrame, new: DataFrame, show: int = 3) -> DataFrame:
    """(content_sha256): the smallest few contents of a new holdout that any prior one has."""
    return new.select("content_sha256").where("content_sha256 is not null").distinct().join(prior.select("content_sha256").distinct(), "content_sha256", "left_semi").orderBy("content_sha256").limit(show)


def assignment_check(ids: DataFrame, assignments: DataFrame, split: str) -> DataFrame:
    """(sample_id, problem): predictions whose sample has no assignment or one to another split."""
    found = ids.select("sample_id").join(assignments.select("sample_id", F.col("split").alias("problem")), "sample_id", "left")
    return found.where(F.col("problem").isNull() | (F.col("problem") != split)).select("sample_id", F.coalesce("problem", F.lit("missing")).alias("problem"))


def first_leak(training: DataFrame, holdout: DataFrame) -> DataFrame:
    """The one row that an audit stops at: first holdout, first check, smallest value. ``holdout`` carries holdout_order."""
    order = holdout.groupBy("holdout_id").agg(F.min("holdout_order").alias("holdout_order"))
    if not order.limit(1).collect():
        raise ValueError("no holdout is registered")
    found = None
    for i, check in enumerate(CHECKS):
        rows = overlap(training, holdout, check).groupBy("holdout_id").agg(F.min("value").alias("value")).select("holdout_id", F.lit(i).cast("bigint").alias("check_order"), F.lit(check).alias("check_name"), "value")
        found = rows if found is None else found.unionByName(rows)
    return found.join(order, "holdout_id").orderBy("holdout_order", "check_order", "value").limit(1)


def shared_preview(left: DataFrame, right: DataFrame, fields: list[str], show: int = 3) -> DataFrame:
    """(field, shared, preview): how many values two sides share per field, and the smallest few.

    The preview is cut before it is collected, so that any number of shared values fits.
    """
    pair = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*").where("value is not null").distinct()
    from pyspark.sql import Window

    both = pair(left).join(pair(right), ["field", "value"])
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("field").orderBy("value"))).where(F.col("n") <= show)
    counted = both.groupBy("field").agg(F.count("*").alias("shared"))
    return counted.join(first.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("preview")), "field")


def set_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(side, key): what ``actual`` is missing and what it has extra."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    missing = e.join(a, key, "left_anti").select(F.lit("missing").alias("side"), key)
    return missing.unionByName(a.join(e, key, "left_anti").select(F.lit("extra").alias("side"), key))
