"""Group-disjoint splits on 30 groups of two samples."""

import math
from collections import defaultdict

import pytest

from plumbline.operators import splitting
from plumbline.operators.validate import ContractError

SCHEMA = "sample_id string, source_id string, label int, provenance_group string"
RATIOS = (0.7, 0.2, 0.1)


def samples():
    return [(f"s{g}-{j}", "source-a" if g % 3 else "source-b", g % 2, f"g{g}") for g in range(30) for j in range(2)]


def counts(n, ratios):
    raw = [(n - 3) * r for r in ratios]
    out = [math.floor(x) for x in raw]
    for i in sorted(range(3), key=lambda i: (-(raw[i] - out[i]), i))[: n - 3 - sum(out)]:
        out[i] += 1
    return [x + 1 for x in out]


def test_groups_stay_together_and_counts_are_right(spark):
    rows = samples()
    df = spark.createDataFrame(rows, SCHEMA)
    split = {r["sample_id"]: r["split"] for r in splitting.assign_groups(df, RATIOS, "323").collect()}
    assert split.keys() == {r[0] for r in rows}
    of: dict = defaultdict(set)
    strata: dict = defaultdict(lambda: defaultdict(set))
    for sample, source, label, group in rows:
        of[group].add(split[sample])
        strata[label, source][split[sample]].add(group)
    assert all(len(s) == 1 for s in of.values())
    for parts in strata.values():
        assert [len(parts[s]) for s in splitting.SPLITS] == counts(sum(map(len, parts.values())), RATIOS)
    again = splitting.assign_groups(df.repartition(7), RATIOS, "323").collect()
    assert {r["sample_id"]: r["split"] for r in again} == split
    assert {r["sample_id"]: r["split"] for r in splitting.assign_groups(df, RATIOS, "other").collect()} != split


@pytest.mark.parametrize("n", [3, 4, 7, 90, 170, 333])
def test_largest_remainders(spark, n):
    groups = spark.createDataFrame([(f"g{i}", "s") for i in range(n)], "provenance_group string, stratum string")
    assert list(splitting.split_counts(groups, RATIOS).first())[2:] == counts(n, RATIOS)


def test_errors(spark):
    rows = samples()
    make = lambda more: spark.createDataFrame([*rows, *more], SCHEMA)
    for bad in ([("x", "lonely", 0, "gx")], [("x", "source-a", 1, "g4")], [rows[0]]):
        with pytest.raises(ContractError):
            splitting.assign_groups(make(bad), RATIOS, "323")
    with pytest.raises(ValueError):
        splitting.assign_groups(make([]), RATIOS, "")
    with pytest.raises(ValueError):
        splitting.assign_groups(make([]), (0.5, 0.2, 0.1), "323")


def test_crossing(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "validation"), ("b", "train"), ("b", "train")], "provenance_group string, split string")
    assert [r[0] for r in splitting.group_crossing(df).collect()] == ["a"]
