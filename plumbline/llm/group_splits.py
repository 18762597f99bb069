"""Problem 5: splits that keep related records together.

Records and what they share (author, source, entity) form a graph. Hash-to-min finds
its components: every node holds a cluster, sends the cluster's minimum to all members
and all members to the minimum, until nothing changes. A component goes to one split by
weighted rendezvous hashing, so that a split depends on the component and the ratios
alone and few components move when ratios change.

A record links its groups; records with a single group add no edge, so the iteration
runs over groups that some record ties together, never over all rows. Clusters are rows,
not collected sets, and minima are combined before each shuffle, so a group with a third
of all rows is no hot task.

Nulls: records with a null key don't count; a record without a group is a component of
its own. Repeated rows count once. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import unit_number
from plumbline.session import Workspace


def components(edges: DataFrame, workspace: Workspace, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each node's component, by hash-to-min.

    ``edges`` holds (a, b) strings; nodes without an edge don't occur. Each round is
    written to the shared folder and the one before it deleted.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    one_way = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = one_way.select("a").distinct().select("a", F.col("a").alias("b"))
    clusters = workspace.put(one_way.unionByName(own).distinct(), f"{name}-0")
    for i in range(1, most_rounds + 1):
        low = clusters.groupBy("a").agg(F.min("b").alias("low"))
        members = clusters.join(low, "a")
        sent = members.select(F.col("low").alias("a"), "b").unionByName(members.select(F.col("b").alias("a"), F.col("low").alias("b")))
        before, clusters = clusters, workspace.put(sent.distinct(), f"{name}-{i}")
        # Both rounds hold distinct rows: they are the same if every row occurs twice.
        changed = before.unionByName(clusters).groupBy("a", "b").agg(F.count("*").alias("n")).where("n <> 2")
        stable = not changed.limit(1).collect()
        workspace.drop(f"{name}-{i - 1}")
        if stable:
            return clusters.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.col("low").alias("component"))
    raise RuntimeError(f"components not stable after {most_rounds} rounds")


def group_components(membership: DataFrame, workspace: Workspace) -> DataFrame:
    """(grp, component) for every group; groups that no record ties to another are their own component.

    ``membership`` holds distinct (key, grp), neither null.
    """
    low = membership.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high")
    edges = membership.join(low.select("key", "low"), "key").where("grp <> low").select(F.col("low").alias("a"), F.col("grp").alias("b"))
    tied = components(edges, workspace)
    groups = membership.select("grp").distinct()
    return groups.join(tied, groups["grp"] == tied["node"], "left").select("grp", F.coalesce("component", "grp").alias("component"))


def rendezvous(component: Column, weights: dict[str, float], seed: str) -> Column:
    """The split with the highest weight / -ln(u), u the pair's hash number; ties go to the smaller name."""
    best_score, best = None, None
    for split in sorted(weights):
        if weights[split] <= 0:
            continue
        score = F.lit(float(weights[split])) / -F.log(unit_number(seed, F.lit(split), component))
        if best is None:
            best_score, best = score, F.lit(split)
        else:
            best, best_score = F.when(score > best_score, F.lit(split)).otherwise(best), F.greatest(score, best_score)
    return best


def check_ratios(ratios: dict[str, float]) -> None:
    if not ratios or any(not math.isfinite(r) or r < 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-9:
        raise ValueError("ratios must be finite, not negative and add up to 1")


def assign_splits(sizes: DataFrame, ratios: dict[str, float], seed: str) -> DataFrame:
    """(component, n, split), by weighted rendezvous hashing alone.

    The split is an expression of the component's name, the ratios and the seed: nothing
    is counted, so no later batch moves a component that it does not touch. ``sizes``
    holds (component, n records).
    """
    check_ratios(ratios)
    return sizes.select("component", "n", rendezvous(F.col("component"), ratios, seed).alias("split"))


def torn_groups(assignments: DataFrame, membership: DataFrame, of_group: DataFrame) -> DataFrame:
    """(manifest, grp): groups whose records a manifest assigns to two or more splits.

    A component belongs to one split; components that a manifest gives two or more are
    torn. The exact check then looks at the groups of torn components only. Everything
    is min and max, combined before the shuffle.
    ``assignments``: distinct (manifest, key, split); ``membership``: distinct (key, grp).
    """
    component = membership.join(of_group, "grp").select("key", "component", "grp")
    rows = assignments.join(component, "key")
    torn = rows.groupBy("manifest", "component").agg(F.min("split").alias("least"), F.max("split").alias("most")).where("least <> most").select("manifest", "component")
    groups = rows.join(torn, ["manifest", "component"], "left_semi").groupBy("manifest", "grp").agg(F.min("split").alias("low"), F.max("split").alias("high"))
    return groups.where("low <> high").select("manifest", "grp")
