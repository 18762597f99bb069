"""Deterministic selection by hash rank: strata, quotas, greedy whole groups, epochs, checkpoints.

Results depend on keys and seed alone, never on row order or partitioning. Keys must be
unique and not null; ``validate`` reports those that are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.hashing import joined_digest
from plumbline.operators.ranking import digest_rank
from plumbline.operators.validate import duplicates, require_empty, unknown_keys


def best_of(df: DataFrame, stratum: list[str], key: str, digest: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each stratum by (digest, key), with their rank.

    A literal bound on the row number lets Spark cut every partition's groups before
    the shuffle.
    """
    if isinstance(most, bool) or not isinstance(most, int) or most < 1:
        raise ValueError("a quota must be a positive whole number")
    order = Window.partitionBy(*stratum).orderBy("_digest", key)
    return df.withColumn("_digest", digest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("rank", F.col("rank").cast("bigint")).drop("_digest")


def shortfall(df: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Strata of ``wanted`` (on..., quota) that have fewer rows than their quota."""
    have = df.groupBy(*on).agg(F.count("*").alias("available"))
    return wanted.join(have, on, "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint")).where("available < quota")


def balanced_strata(rows: DataFrame, content_types: list[str], k: int, seed: str) -> DataFrame:
    """The first k file names of every requested content type and label."""
    check_seed(seed)
    if not content_types or len(set(content_types)) != len(content_types):
        raise ValueError("content types must be named once each")
    asked = rows.where(F.col("content_type").isin(*content_types) & F.col("label").isin("0_real", "1_fake"))
    return best_of(asked, ["content_type", "label"], "file_name", joined_digest(seed, F.col("file_name")), k)


def rotating_quota(k: int, generators: int, type_number: int, generator_number: int) -> int:
    """k dealt over the generators; the remainder starts one round further on with each content type."""
    base, extra = divmod(k, generators)
    return base + int((generator_number - type_number * extra) % generators < extra)


def generator_strata(rows: DataFrame, content_types: list[str], generators: list[str], k: int, seed: str) -> DataFrame:
    """Per content type k real files and k fakes spread over the listed generators.

    ``rows`` carries generator_family. Fakes of other generators are left out.
    """
    check_seed(seed)
    if not generators or len(set(generators)) != len(generators):
        raise ValueError("generators must be named once each")
    quotas = [(c, "1_fake", g, rotating_quota(k, len(generators), i, j)) for i, c in enumerate(content_types) for j, g in enumerate(generators)]
    quotas += [(c, "0_real", "", k) for c in content_types]
    spark = rows.sparkSession
    wanted = spark.createDataFrame(quotas, "content_type string, label string, slot string, quota bigint")  # types x generators rows
    slot = F.when(F.col("label") == "1_fake", F.col("generator_family")).otherwise("")
    placed = rows.withColumn("slot", slot).join(F.broadcast(wanted), ["content_type", "label", "slot"])
    return best_of(placed, ["content_type", "label", "slot"], "file_name", joined_digest(seed, F.col("file_name")), k).where("rank <= quota").drop("quota", "slot")


def hash_slice(rows: DataFrame, key: str, n: int, seed: str, name: str = "slice") -> DataFrame:
    """(key): the first n distinct keys by hash, the same in every run; too few keys are an error."""
    check_seed(seed)
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    if keys.limit(n).count() < n:
        raise ValueError(f"fewer than {n} keys")
    return keys.orderBy(joined_digest(seed, name, F.col(key)), key).limit(n)


def eligible(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not excluded. Excluded keys that no row has should be an error; see ``unknown_keys``."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def check_seed(seed: str) -> None:
    if not seed:
        raise ValueError("the seed must not be empty")


def quota_violations(rows: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(rule, key): repeated keys, sources that have no quota, and sources with fewer rows than theirs."""
    wanted = rows.sparkSession.createDataFrame(sorted(quotas.items()), "source string, quota bigint")  # a row per source
    found = duplicates(rows, ["key"])
    found = found.unionByName(unknown_keys(rows, "source", wanted).select(F.lit("source without quota").alias("rule"), F.col("source").alias("key")))
    return found.unionByName(shortfall(rows, wanted, ["source"]).select(F.lit("too few rows").alias("rule"), F.col("source").alias("key")))


def source_quotas(rows: DataFrame, quotas: dict[str, int], seed: str, reserve: int = 0) -> DataFrame:
    """The first quota (plus ``reserve``) rows of each source by hash rank. ``quota_violations`` tells what is wrong with the rows."""
    check_seed(seed)
    wanted = rows.sparkSession.createDataFrame(sorted(quotas.items()), "source string, quota bigint")  # a row per source
    digest = joined_digest(seed, F.col("source"), F.col("key"))
    ranked = best_of(rows.join(F.broadcast(wanted), "source"), ["source"], "key", digest, max(quotas.values()) + reserve)
    return ranked.where(F.col("rank") <= F.col("quota") + reserve).drop("quota")


def greedy_groups(groups: DataFrame, cap: int | None, block: int = 20_000) -> DataFrame:
    """Groups taken whole, in digest order, skipping those that no longer fit the cap.

    ``groups``: (grp, n, digest). The order is read in blocks of a fixed size; after a
    block only groups that still fit are looked at, so the driver holds one block and
    the taken names (at most ``cap`` of them).
    """
    if cap is None:
        return groups.select("grp")
    left, last, taken = cap, None, []
    while left > 0:
        rest = groups.where(F.col("n") <= left)
        if last is not None:
            rest = rest.where((F.col("digest") > last[0]) | ((F.col("digest") == last[0]) & (F.col("grp") > last[1])))
        rows = rest.orderBy("digest", "grp").limit(block).select("grp", "n", "digest").collect()
        for row in rows:
            if row["n"] <= left:
                left -= row["n"]
                taken.append((row["grp"],))
        if len(rows) < block:
            break
        last = (rows[-1]["digest"], rows[-1]["grp"])
    return groups.sparkSession.createDataFrame(taken, "grp string")


def profile_subset(samples: DataFrame, profile: str, split: str, cap: int | None, seed: str) -> DataFrame:
    """(sample_id, label, provenance_group) of the whole groups that a profile's cap admits, per label."""
    out = None
    groups = samples.groupBy("label", "provenance_group").agg(F.count("*").alias("n"))
    groups = groups.select(F.col("label"), F.col("provenance_group").alias("grp"), "n", joined_digest(seed, profile, split, F.col("label"), F.col("provenance_group")).alias("digest"))
    for label in (0, 1):
        chosen = greedy_groups(groups.where(F.col("label") == label), cap).withColumnRenamed("grp", "provenance_group")
        rows = samples.where(F.col("label") == label).join(chosen, "provenance_group", "left_semi").select("sample_id", "label", "provenance_group")
        out = rows if out is None else out.unionByName(rows)
    return out


def balanced_epoch(samples: DataFrame, epoch: int, seed: str) -> DataFrame:
    """(position, sample_id, label): both classes in turn, the smaller one repeated until it is as long."""
    ranked = digest_rank(samples.select("sample_id", "label", joined_digest(seed, "balanced", epoch, F.col("label"), F.col("sample_id")).alias("digest")), ["label"], "digest", ["sample_id"])
    sizes = samples.groupBy("label").agg(F.count("*").alias("n"))
    n = {r["label"]: r["n"] for r in sizes.where("label in (0, 1)").collect()}  # two rows
    if len(n) < 2:
        raise ValueError("both classes are needed")
    out = None
    for label in (epoch % 2, 1 - epoch % 2):
        # The turns are rows that meet the ranked records, so a record of a small class is no long array.
        turns = samples.sparkSession.range(max(n.values())).select(F.col("id").alias("turn"), (F.col("id") % n[label] + 1).alias("rank"))
        position = (2 * F.col("turn") + int(label != epoch % 2)).cast("bigint").alias("position")
        rows = turns.join(ranked.where(F.col("label") == label), "rank").select(position, "sample_id", "label")
        out = rows if out is None else out.unionByName(rows)
    return out


def best_checkpoint(candidates: DataFrame, metric: str = "bce") -> DataFrame:
    """The one winner: least BCE, or most balanced accuracy, ties by epoch, step and id."""
    if metric not in ("bce", "balanced_accuracy"):
        raise ValueError("metric must be bce or balanced_accuracy")
    lead = F.col("validation_bce") if metric == "bce" else -F.col("validation_balanced_accuracy")
    require_empty(candidates.where(lead.isNull()).select("checkpoint_id"), f"no {metric}")
    require_empty(duplicates(candidates, ["checkpoint_id"]), "repeated checkpoints")
    return candidates.orderBy(lead, "epoch", "global_step", "checkpoint_id").limit(1)


def running_best(candidates: DataFrame) -> DataFrame:
    """(epoch, best_id, best_bce): the winner among the epochs so far. A history has a row per epoch."""
    best = F.min(F.struct("validation_bce", "epoch", "global_step", "checkpoint_id")).over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0))
    return candidates.withColumn("best", best).select("epoch", F.col("best.checkpoint_id").alias("best_id"), F.col("best.validation_bce").alias("best_bce"))


def history_gaps(history: DataFrame) -> DataFrame:
    """(epoch, problem): epochs that don't follow their predecessor by one, or steps that don't rise."""
    order = Window.orderBy("epoch")
    before = history.withColumn("last_epoch", F.coalesce(F.lag("epoch").over(order), F.lit(0))).withColumn("last_step", F.lag("global_step").over(order))
    gap, step = F.col("epoch") != F.col("last_epoch") + 1, F.col("last_step").isNotNull() & (F.col("global_step") <= F.col("last_step"))
    return before.where(gap | step).select(F.col("epoch").cast("bigint").alias("epoch"), F.when(gap, "epoch").otherwise("step").alias("problem"))


def ema(values: DataFrame, decay: float) -> DataFrame:
    """One row: the exponential moving average of ``value`` by ``step``, which counts from 1, started at the first value."""
    n = values.agg(F.max("step").alias("last"))
    weight = F.pow(F.lit(decay), F.col("last") - F.col("step")) * F.when(F.col("step") == 1, 1.0).otherwise(1.0 - decay)
    return values.crossJoin(F.broadcast(n)).agg(F.sum(weight * F.col("value")).alias("ema"))  # one row
