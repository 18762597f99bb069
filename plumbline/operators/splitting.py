"""Group-disjoint stratified splits.

A provenance group's stratum is its label and its sorted sources. In each stratum the
groups are ranked by hash and cut at counts that come from the ratios by largest
remainders, one group of each split being set aside first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import joined_digest
from plumbline.operators.ranking import digest_rank
from plumbline.operators.validate import duplicates, require_empty

SPLITS = ("train", "validation", "calibration")


def stratum_text(label: Column, sources: Column) -> Column:
    """The stratum as text: ``(1, ('a', 'b'))``, with a comma after a single source. Sources hold no quotes."""
    listed = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", ")
    return F.concat(F.lit("("), label.cast("string"), F.lit(", ("), listed, F.when(F.size(sources) == 1, ",").otherwise(""), F.lit("))"))


def groups_of(samples: DataFrame) -> DataFrame:
    """(provenance_group, label, stratum, n). Groups with two labels are left to ``conflicting_groups``.

    A group's sources are few (the set is of source names), its rows may be many.
    """
    found = samples.groupBy("provenance_group").agg(F.min("label").alias("label"), F.max("label").alias("_high"), F.array_sort(F.collect_set("source_id")).alias("sources"), F.count("*").alias("n"))
    return found.where("label = _high").select("provenance_group", "label", stratum_text(F.col("label"), F.col("sources")).alias("stratum"), "n")


def conflicting_groups(samples: DataFrame) -> DataFrame:
    """Groups whose records carry both labels."""
    return samples.groupBy("provenance_group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("provenance_group")


def thin_strata(groups: DataFrame) -> DataFrame:
    """Strata with fewer than three groups, which cannot reach all splits."""
    return groups.groupBy("stratum").agg(F.count("*").alias("groups")).where("groups < 3")


def split_counts(groups: DataFrame, ratios: tuple[float, float, float]) -> DataFrame:
    """(stratum, groups, train_groups, validation_groups, calibration_groups) of strata with three groups or more."""
    if any(r <= 0 for r in ratios) or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must be positive and add up to 1")
    counted = groups.groupBy("stratum").agg(F.count("*").alias("groups")).where("groups >= 3").withColumn("_free", F.col("groups") - 3)
    for i, r in enumerate(ratios):
        raw = F.col("_free").cast("double") * F.lit(float(r))
        counted = counted.withColumn(f"_base{i}", F.floor(raw)).withColumn(f"_rest{i}", raw - F.floor(raw))
    left = F.col("_free") - F.col("_base0") - F.col("_base1") - F.col("_base2")
    out = []
    for i, name in enumerate(SPLITS):
        ahead = F.lit(0)
        for j in range(3):
            if j != i:
                better = F.col(f"_rest{j}") > F.col(f"_rest{i}") if j > i else F.col(f"_rest{j}") >= F.col(f"_rest{i}")
                ahead = ahead + better.cast("int")
        out.append((F.col(f"_base{i}") + 1 + (ahead < left).cast("int")).cast("bigint").alias(f"{name}_groups"))
    return counted.select("stratum", "groups", *out)


def assign_groups(samples: DataFrame, ratios: tuple[float, float, float], seed: str) -> DataFrame:
    """(sample_id, split): every sample inherits its group's split.

    Repeated samples, groups with both labels and strata of fewer than three groups are errors.
    """
    if not seed:
        raise ValueError("the seed must not be empty")
    groups = groups_of(samples)
    require_empty(duplicates(samples, ["sample_id"]), "repeated samples")
    require_empty(conflicting_groups(samples), "a group with both labels")
    require_empty(thin_strata(groups), "a stratum with fewer than three groups")
    ranked = digest_rank(groups.withColumn("digest", joined_digest(seed, F.col("stratum"), F.col("provenance_group"))), ["stratum"], "digest", ["provenance_group"])
    cut = ranked.join(split_counts(groups, ratios), "stratum")
    split = F.when(F.col("rank") <= F.col("train_groups"), SPLITS[0]).when(F.col("rank") <= F.col("train_groups") + F.col("validation_groups"), SPLITS[1]).otherwise(SPLITS[2])
    return samples.select("sample_id", "provenance_group").join(cut.select("provenance_group", split.alias("split")), "provenance_group").select("sample_id", "split")


def group_crossing(assigned: DataFrame) -> DataFrame:
    """Groups with more than one split; ``assigned``: (provenance_group, split)."""
    return assigned.groupBy("provenance_group").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low <> high").select("provenance_group")
