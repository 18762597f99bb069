"""Problem 4: a sample that matches target category proportions.

The wanted categories form a tree: target set, source, generator, content type and
label. Each leaf's quota is its share of the sample by largest remainders, at least its
minimum. What a leaf cannot supply is passed first to its siblings (same source and
generator), then to its cousins (same source, then the whole set), in proportion to
their own quotas and up to what they have. Within a leaf the records are drawn by their
dense rank in a hash permutation.

The tree has one row per target, so the allocation runs per target set on those rows
alone. The draw ranks nothing but the boundary: the permutation is cut into SLICES, the
slices below the quota are taken whole, and only records of the slice in which the
quota is reached are ranked, so a leaf with a third of all rows is no hot task.

Nulls: records with a null key, source, content type or label are in no category. A
null generator in a target matches null only. A record counts once per category; it is
drawn for the first of its categories (by target_id) only. Empty tables give empty
results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.hashing import by_value, hash_number
from plumbline.session import Workspace

SLICES = 1024
CATEGORY = ["source_id", "generator_family", "content_type", "label"]
_SUPPLY = "target_id int, target_set string, wanted double, min_records bigint, sample_size bigint, available bigint, quota bigint, unmet double, passed_on bigint"


def supply(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target with the number of distinct records of its category.

    ``records``: (key, *CATEGORY), normalised. Categories without a target don't matter
    here; targets without records have 0.
    """
    valid = records.where("key is not null and source_id is not null and content_type is not null and label is not null")
    counts = valid.select("key", *CATEGORY).distinct().groupBy(*CATEGORY).agg(F.count("*").alias("available"))
    same = None
    for c in CATEGORY:
        equal = F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}"))
        same = equal if same is None else same & equal
    return targets.alias("t").join(counts.alias("c"), same, "left").select("t.*", F.coalesce("c.available", F.lit(0)).cast("bigint").alias("available"))


def shortfalls(allotted: DataFrame) -> DataFrame:
    """Rows of ``allocation`` whose category cannot give its share of the sample, or its minimum."""
    return allotted.where("unmet > 0")


def _rounded(wanted: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers near ``wanted`` that add up to ``total``, by largest remainders (ties: the first)."""
    low = np.floor(wanted + 1e-9)
    rest = int(round(total - low.sum()))
    order = np.lexsort((np.arange(len(wanted)), -(wanted - low)))
    if len(order) and rest > 0:
        low[order[np.arange(rest) % len(order)]] += 1
    return low.astype(np.int64)


def _pass_on(unmet: int, quota: np.ndarray, room: np.ndarray, weight: np.ndarray) -> int:
    """Gives ``unmet`` to where there is room, by weight; returns what found none. Changes quota and room."""
    while unmet > 0 and room.sum() > 0:
        w = np.where(room > 0, np.maximum(weight, 1e-12), 0.0)
        give = np.minimum(_rounded(unmet * w / w.sum(), unmet) if unmet < room.sum() else room, room)
        quota += give
        room -= give
        unmet -= int(give.sum())
    return unmet


def allocate(targets: pd.DataFrame) -> pd.DataFrame:
    """The quotas of one target set.

    ``unmet`` is what a leaf's category lacks of its share or its minimum, before others
    step in; ``passed_on`` is the part of its whole-number quota that was passed to
    siblings and cousins. A null share, minimum or size counts as 0.
    """
    t = targets.sort_values("target_id").reset_index(drop=True)
    size = int(t["sample_size"].fillna(0).max())
    share = np.nan_to_num(t["target_share"].to_numpy(float, na_value=np.nan))
    minimum, have = t["min_records"].fillna(0).to_numpy(np.int64), t["available"].to_numpy(np.int64)
    want = np.maximum(_rounded(share / max(share.sum(), 1e-300) * size, size), minimum)
    over = int(want.sum() - size)  # minima above the share are paid for by those above their minimum
    while over > 0 and (spare := want - minimum).sum() > 0:
        cut = np.minimum(_rounded(min(over, spare.sum()) * spare / spare.sum(), int(min(over, spare.sum()))), spare)
        want -= cut
        over -= int(cut.sum())
    quota = np.minimum(want, have)
    room, unmet = have - quota, want - quota
    source, generator = t["source_id"].fillna("").to_numpy(), t["generator_family"].fillna("").to_numpy()
    for level in (np.char.add(source.astype(str), np.char.add("\x1f", generator.astype(str))), source.astype(str), np.full(len(t), "")):
        for branch in np.unique(level):
            here = level == branch
            need = int(unmet[here].sum())
            if need == 0:
                continue
            q, r = quota[here], room[here]
            left = _pass_on(need, q, r, share[here])
            quota[here], room[here] = q, r
            # What is still unmet stays booked on the branch for the next level up.
            carried = np.zeros(here.sum(), np.int64)
            carried[0] = left
            unmet[here] = carried
    wanted = share * t["sample_size"].fillna(0).to_numpy(float)
    # What the leaf itself lacks of its share or minimum, and what of its whole quota went to others.
    lacks, passed = np.maximum(np.maximum(wanted, minimum) - have, 0.0), np.maximum(want - have, 0)
    return pd.DataFrame({"target_id": t["target_id"], "target_set": t["target_set"], "wanted": wanted, "min_records": minimum, "sample_size": size, "available": have, "quota": quota, "unmet": lacks, "passed_on": passed})


def allocation(supplied: DataFrame) -> DataFrame:
    """(target_id, ..., quota) of all targets; a group here is one target set's few rows."""
    return supplied.groupBy("target_set").applyInPandas(allocate, _SUPPLY)


def draw(records: DataFrame, targets: DataFrame, quotas: DataFrame, seed: str, workspace: Workspace) -> DataFrame:
    """(target_set, target_id, key): ``quota`` records of each leaf, the first in the leaf's hash permutation."""
    valid = records.where("key is not null and source_id is not null and content_type is not null and label is not null").select("key", *CATEGORY).distinct()
    same = None
    for c in CATEGORY:
        equal = F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
        same = equal if same is None else same & equal
    leaf = valid.alias("r").join(targets.alias("t"), same).select("t.target_set", "t.target_id", "r.key")
    once = leaf.groupBy("target_set", "key").agg(F.min("target_id").alias("target_id"))
    number = hash_number(seed, F.col("target_set"), F.col("key"))
    drawn = workspace.put(once.withColumn("number", number).withColumn("slice", F.shiftright("number", 38).cast("int")), "leaves")
    per_slice = drawn.groupBy("target_id", "slice").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("target_id").orderBy("slice")
    reached = per_slice.withColumn("upto", F.sum("n").over(upto)).join(quotas.select("target_id", "quota"), "target_id")
    take = reached.withColumn("rest", F.col("quota") - (F.col("upto") - F.col("n"))).where("rest > 0").select("target_id", "slice", "rest", (F.col("n") <= F.col("rest")).alias("whole"))
    chosen = drawn.join(take, ["target_id", "slice"])
    rank = F.dense_rank().over(Window.partitionBy("target_id", "slice").orderBy("number", "key"))
    edge = chosen.where("not whole").withColumn("rank", rank).where(F.col("rank") <= F.col("rest"))
    out = ["target_set", "target_id", "key"]
    return chosen.where("whole").select(*out).unionByName(edge.select(*out))


by_value()
