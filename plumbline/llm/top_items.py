"""Problem 3: the top N items within every group.

Items are written once, split by descending score bands. The bands are then processed
from the top: each band reads its own files only, drops the groups that are already
filled (anti-join), and counts what it brings to the rest. A group is finished in the
band in which it reaches N, its boundary band; the exact rank with the tie rule is
taken over what was kept.

Within a band the rank limit comes before the anti-join, so that every task that reads
the band first cuts each group to its own N best: what a group with a third of all rows
sends over the network is N rows per reading task, and the anti-join and the final rank
reuse the partitioning by group that this limit has made. Spark cuts so for N up to
``spark.sql.optimizer.windowGroupLimitThreshold`` (1,000 unless set), which a larger N
should raise.

Nulls: rows with a null group column, key or score, and NaN scores, don't count. Of a
key's scores in a group the highest counts; repeated rows are one item. Ties go to the
smaller key. -0.0 equals 0.0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import Workspace


def band_cuts(scores: DataFrame, bands: int) -> list[float]:
    """Descending score limits; each band holds about twice the share of the one above it."""
    shares = [1 - 2.0 ** (i + 1 - bands) for i in range(bands - 1)]
    cuts = scores.agg(F.percentile_approx("score", shares, 1000).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []), reverse=True)


def top_items(items: DataFrame, group: list[str], n: int, workspace: Workspace, more_than: int = 0, bands: int = 5) -> DataFrame:
    """(group..., key, score, rank) of the ``n`` best items of each group with more than ``more_than`` items.

    ``items`` holds the group columns, ``key`` and ``score``. Repeated keys are combined
    under group and key, which spreads a huge group over all partitions.
    """
    if n < 1 or bands < 1:
        raise ValueError("n and bands must be positive")
    valid = items.where(" and ".join(f"`{c}` is not null" for c in [*group, "key", "score"])).where(~F.isnan("score"))
    keyed = valid.groupBy(*group, "key").agg(F.max(F.col("score") + 0.0).alias("score"))
    cuts = band_cuts(valid.select("score"), bands)
    band = F.lit(0)
    for cut in cuts:
        band = band + F.when(F.col("score") < cut, 1).otherwise(0)
    workspace.put(keyed.withColumn("band", band), "items", partition_by=["band"])
    stored = workspace.spark.read.schema(T.StructType([*keyed.schema.fields, T.StructField("band", T.IntegerType())])).parquet(workspace.path("items"))

    filled = None
    if more_than > 0:  # small groups are as good as filled
        small = stored.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") <= more_than)
        filled = workspace.put(small.select(*group), "small")
    counts, kept = None, []
    for b in range(len(cuts) + 1):
        best = Window.partitionBy(*group).orderBy(F.col("score").desc(), "key")
        taken = stored.where(F.col("band") == b).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).drop("band", "rank")
        if filled is not None:
            taken = taken.join(filled, group, "left_anti")
        kept.append(workspace.put(taken, f"band-{b}"))
        if b == len(cuts):
            break
        counts = kept[-1].select(*group) if counts is None else counts.unionByName(kept[-1].select(*group))
        full = counts.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") >= n).select(*group)
        done = full if more_than <= 0 else full.unionByName(workspace.get("small", full))
        filled = workspace.put(done, f"filled-{b}")
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    best = Window.partitionBy(*group).orderBy(F.col("score").desc(), "key")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
