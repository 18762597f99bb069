"""Problem 8: mixing sources to target weights.

Poisson replication: each target wants its source repeated at a mean rate. A document
draws a permanent number u from a hash of the seed, the mixture and its id, and its
number of copies inverts a Poisson distribution at u. The copies of all documents are
then exploded and put in one global hash order.

Drawn with the plain mean (wanted over available size), the copies of a source with few
documents would miss the wanted size by far. So the mean is taken at which the copies
that the documents' own numbers give add up to the wanted size: the total rises step by
step with the mean, and the step nearest to the wanted size is used. A new document moves
that mean a little and no other document's u; most copies stay. Copies above the repeat
cap are cut off, which the search for the mean takes into account. Where even the cap
cannot give the wanted size, every document is repeated cap times and the target is
reported as short.

The search needs sizes per interval of u only: BINS sums per target, whatever the number
of documents. Copies then follow from the document's row and the target's few limits,
without a shuffle of the documents.

Nulls: documents with a null id or source, or without words, and targets with a null
share, cap or budget are skipped. Ids are taken to be unique; of repeated rows one
counts. A target without documents is short unless it wants nothing. Empty tables give
empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import by_value, hash_number

#: Intervals of u, as the power of two; ``hash_number`` has 48 bits.
BITS = 16
BINS = 1 << BITS
_LIMITS = "mixture_id string, source string, limits array<int>"


def below(mean: float, cap: int) -> np.ndarray:
    """P(X < 1), ..., P(X < cap) of the Poisson variable with this mean."""
    if mean <= 0:
        return np.ones(cap)
    terms = np.array([j * math.log(mean) - mean - math.lgamma(j + 1) for j in range(cap)])
    return np.minimum(np.cumsum(np.exp(terms)), 1.0)


def limits_at(mean: float, cap: int) -> np.ndarray:
    """The intervals of u from which a document has 1, ..., cap copies."""
    return np.ceil(below(mean, cap) * BINS).astype(np.int64)


def limits_for(sizes: np.ndarray, wanted: float, cap: int) -> list[int]:
    """The limits whose copies add up to the wanted size as nearly as any mean allows.

    ``sizes``: the size of all documents in each interval of u.
    """
    if cap < 1 or wanted <= 0:
        return [BINS] * max(cap, 0)
    if wanted >= cap * sizes.sum():
        return [0] * cap
    above = np.concatenate([np.cumsum(sizes[::-1])[::-1], [0]])  # size from an interval on
    total = lambda mean: int(above[limits_at(mean, cap)].sum())
    low, high = 0.0, 1.0
    while total(high) < wanted and high < 1e9:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < wanted else (low, middle)
    return limits_at(low if wanted - total(low) < total(high) - wanted else high, cap).tolist()


def interval(seed: str, mixture: Column, doc_id: Column) -> Column:
    """The interval of the document's u."""
    return F.shiftright(hash_number(seed, mixture, doc_id), 48 - BITS).cast("int")


def _limits(rows: pd.DataFrame) -> pd.DataFrame:
    one = rows.iloc[0]
    sizes = np.zeros(BINS, np.int64)
    sizes[rows["bin"].to_numpy()] = rows["size"].to_numpy()
    return pd.DataFrame({"mixture_id": [one["mixture_id"]], "source": [one["source"]], "limits": [limits_for(sizes, float(one["wanted"]), int(one["max_repeats"]))]})


def plan(items: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Each target with its wanted and available size, shortage and the limits of its copies.

    ``items``: (doc_id, source, size); ``targets``: (mixture_id, source, target_share,
    max_repeats, budget), one row per mixture and source.
    """
    valid = targets.where("mixture_id is not null and source is not null and target_share is not null and max_repeats is not null and budget is not null")
    goal = valid.select("mixture_id", "source", "target_share", F.col("max_repeats").cast("int").alias("max_repeats"), "budget", (F.col("target_share") * F.col("budget")).alias("wanted"))
    at = ["mixture_id", "source"]
    bins = items.join(goal.select(*at), "source").groupBy(*at, interval(seed, F.col("mixture_id"), F.col("doc_id")).alias("bin")).agg(F.sum("size").alias("size"))
    have = bins.groupBy(*at).agg(F.sum("size").alias("available"))
    # One group is one target's sums, at most BINS rows.
    limits = bins.join(goal.select(*at, "wanted", "max_repeats"), at).groupBy(*at).applyInPandas(_limits, _LIMITS)
    rows = goal.join(have, at, "left").join(limits, at, "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    return rows.withColumn("short", F.col("wanted") > F.col("max_repeats") * F.col("available"))


def replicate(items: DataFrame, planned: DataFrame, seed: str) -> DataFrame:
    """(mixture_id, source, doc_id, size, copies) of the documents that are taken at least once."""
    each = items.join(planned.select("mixture_id", "source", "limits"), "source").withColumn("bin", interval(seed, F.col("mixture_id"), F.col("doc_id")))
    copies = F.size(F.filter("limits", lambda limit: F.col("bin") >= limit)).cast("int")
    return each.select("mixture_id", "source", "doc_id", "size", copies.alias("copies")).where("copies > 0")


def shares(planned: DataFrame, replicated: DataFrame) -> DataFrame:
    """Per target: what was wanted, what came out, the share reached and whether the source falls short."""
    got = replicated.groupBy("mixture_id", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.max("size").alias("largest"))
    total = got.groupBy("mixture_id").agg(F.sum("taken").alias("whole"))
    row = planned.drop("limits").join(got, ["mixture_id", "source"], "left").join(total, "mixture_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    taken = number("taken").cast("bigint")
    named = ["mixture_id", "source", "target_share", "max_repeats", "budget", "available", "wanted", "short"]
    return row.select(*named, taken.alias("taken"), number("documents").cast("bigint").alias("documents"), number("most_copies").alias("most_copies"), number("largest").cast("bigint").alias("largest"), F.when(F.col("whole") > 0, taken / F.col("whole")).otherwise(0.0).alias("share"))


def shuffled(replicated: DataFrame, seed: str) -> DataFrame:
    """One row per copy, in a global random order that any partitioning gives alike."""
    copies = replicated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    return copies.withColumn("place", hash_number(seed, F.lit("order"), F.col("mixture_id"), F.col("doc_id"), F.col("copy"))).orderBy("place", "mixture_id", "doc_id", "copy")


by_value()
