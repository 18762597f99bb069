"""Selection by hash rank, epochs and checkpoints on the small fixtures."""

import hashlib

import pytest

from plumbline.operators import selection
from plumbline.operators.validate import ContractError

STRATA = "file_name string, label string, content_type string, generator_family string"


def rank(*parts):
    return hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture
def strata(spark):
    rows = [(f"{t}/{label}/{i}.png", label, t, None) for t in ("food", "street") for label in ("0_real", "1_fake") for i in range(5)]
    return rows, spark.createDataFrame([*rows, ("zoo/0_real/1.png", "0_real", "zoo", None)], STRATA)


def test_balanced_strata(strata):
    rows, df = strata
    found = {(r["file_name"], r["rank"]) for r in selection.balanced_strata(df.repartition(5), ["street", "food"], 3, "s").collect()}
    wanted = set()
    for t in ("food", "street"):
        for label in ("0_real", "1_fake"):
            names = sorted((n for n, lab, c, _ in rows if (lab, c) == (label, t)), key=lambda n: (rank("s", n), n))
            wanted |= {(n, i + 1) for i, n in enumerate(names[:3])}
    assert found == wanted and len(found) == 12


def test_generator_strata(spark):
    rows = [(f"{t}/0_real/{i}.png", "0_real", t, None) for t in ("food", "street") for i in range(8)]
    rows += [(f"{t}/1_fake/{g}/{i}.png", "1_fake", t, g) for t in ("food", "street") for g in ("Flux", "sd3.5", "Digicam", "other") for i in range(4)]
    found = selection.generator_strata(spark.createDataFrame(rows, STRATA), ["food", "street"], ["Flux", "sd3.5", "Digicam"], 5, "s").collect()
    fakes = [r["generator_family"] for r in found if r["label"] == "1_fake"]
    assert len(found) == 20 and {g: fakes.count(g) for g in set(fakes)} == {"Flux": 4, "sd3.5": 3, "Digicam": 3}


def test_guards(strata):
    _, df = strata
    for bad in (lambda: selection.balanced_strata(df, [], 3, "s"), lambda: selection.balanced_strata(df, ["food", "food"], 3, "s"), lambda: selection.balanced_strata(df, ["food"], True, "s"), lambda: selection.balanced_strata(df, ["food"], 0, "s"), lambda: selection.balanced_strata(df, ["food"], 3, ""), lambda: selection.generator_strata(df, ["food"], [], 3, "s")):
        with pytest.raises(ValueError):
            bad()


def test_source_quotas(spark):
    rows = [(f"s{i}", f"k{i}-{j}") for i in range(3) for j in range(10)]
    df = spark.createDataFrame(rows, "source string, key string")
    quotas = {"s0": 3, "s1": 3, "s2": 6}
    found = selection.source_quotas(df, quotas, "s").collect()
    assert {s: [r["key"] for r in sorted(found, key=lambda r: r["rank"]) if r["source"] == s] for s in quotas} == {s: sorted((k for t, k in rows if t == s), key=lambda k: (rank("s", s, k), k))[:q] for s, q in quotas.items()}
    assert not selection.quota_violations(df, quotas).count()
    bad = spark.createDataFrame([*rows, ("s9", "new"), ("s0", "k0-0")], df.schema)
    assert {tuple(r) for r in selection.quota_violations(bad, quotas | {"s1": 11}).collect()} == {("duplicate key", "k0-0"), ("source without quota", "s9"), ("too few rows", "s1")}


def test_profile_subset_skips_what_does_not_fit(spark):
    sizes = {f"g{i}": (i % 5) + 1 for i in range(12)}
    rows = [(f"{g}-{j}", 0, g) for g, n in sizes.items() for j in range(n)] + [("x", 1, "h")]
    df = spark.createDataFrame(rows, "sample_id string, label int, provenance_group string")
    used, wanted = 0, set()
    for g in sorted(sizes, key=lambda g: rank("s", "smoke", "train", 0, g)):
        if used + sizes[g] <= 16:
            used += sizes[g]
            wanted.add(g)
    found = selection.profile_subset(df, "smoke", "train", 16, "s").collect()
    assert {r["provenance_group"] for r in found if r["label"] == 0} == wanted and len(found) == used + 1
    assert selection.profile_subset(df, "full", "train", None, "s").count() == len(rows)


def test_greedy_groups_in_blocks(spark):
    groups = spark.createDataFrame([(f"g{i}", (i * 7) % 11 + 1, rank(i)) for i in range(60)], "grp string, n bigint, digest string")
    taken = {tuple(r) for r in selection.greedy_groups(groups, 90, block=7).collect()}
    assert taken == {tuple(r) for r in selection.greedy_groups(groups, 90).collect()}


@pytest.mark.parametrize("epoch", [1, 2])
def test_balanced_epoch(spark, epoch):
    rows = [(f"a{i}", 0) for i in range(3)] + [(f"b{i}", 1) for i in range(8)]
    found = sorted(map(tuple, selection.balanced_epoch(spark.createDataFrame(rows, "sample_id string, label int"), epoch, "s").collect()))
    ranked = {y: sorted((i for i, z in rows if z == y), key=lambda i: rank("s", "balanced", epoch, y, i)) for y in (0, 1)}
    first = epoch % 2
    assert found == [(2 * o + s, ranked[y][o % len(ranked[y])], y) for o in range(8) for s, y in enumerate((first, 1 - first))]
    with pytest.raises(ValueError):
        selection.balanced_epoch(spark.createDataFrame(rows[:3], "sample_id string, label int"), 1, "s")


CHECKPOINTS = "checkpoint_id string, epoch int, global_step int, validation_bce double, validation_balanced_accuracy double"


def test_checkpoints(spark):
    df = spark.createDataFrame([("a", 1, 10, 0.5, 0.81), ("b", 2, 20, 0.4, 0.7), ("c", 3, 30, 0.4, 0.7)], CHECKPOINTS)
    assert selection.best_checkpoint(df).first()["checkpoint_id"] == "b"
    assert selection.best_checkpoint(df, "balanced_accuracy").first()["checkpoint_id"] == "a"
    assert [tuple(r) for r in selection.running_best(df).orderBy("epoch").collect()] == [(1, "a", 0.5), (2, "b", 0.4), (3, "b", 0.4)]
    missing = df.unionByName(spark.createDataFrame([("d", 4, 40, 0.9, None)], CHECKPOINTS))
    with pytest.raises(ContractError):
        selection.best_checkpoint(missing, "balanced_accuracy")
    with pytest.raises(ContractError):
        selection.best_checkpoint(df.unionByName(df.limit(1)))
    with pytest.raises(ValueError):
        selection.best_checkpoint(df, "loss")


def test_history_and_ema(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (4, 30), (5, 30)], "epoch int, global_step int")
    assert {tuple(r) for r in selection.history_gaps(df).collect()} == {(4, "epoch"), (5, "step")}
    values = spark.createDataFrame([(1, 4.0), (2, 2.0), (3, 1.0)], "step int, value double")
    assert selection.ema(values, 0.5).first()["ema"] == pytest.approx(2.0)


def test_slices_and_exclusions(spark):
    df = spark.createDataFrame([(f"n{i % 50}",) for i in range(80)] + [(None,)], "name string")
    names = {r["name"] for r in selection.hash_slice(df, "name", 20, "s").collect()}
    assert names == set(sorted((f"n{i}" for i in range(50)), key=lambda n: rank("s", "slice", n))[:20])
    assert {r["name"] for r in selection.eligible(df.where("name is not null"), selection.hash_slice(df, "name", 20, "s"), "name").collect()} == {f"n{i}" for i in range(50)} - names
    with pytest.raises(ValueError):
        selection.hash_slice(df, "name", 51, "s")
