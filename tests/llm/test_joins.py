"""Problems 5 and 6 on small tables, against brute force."""

import random
from itertools import product

import pytest

from plumbline.llm import group_splits, split_overlap
from plumbline.session import Workspace


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_edit_pairs(spark, k):
    rng = random.Random(k)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14))) for _ in range(60)]

    def edited(s):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "y" + s[i + 1 :]])
        return s

    left, right = [*base, None, "ä" * 20], [*map(edited, base), *base[:5], None, "ä" * 19 + "b"]
    side = lambda values: spark.createDataFrame([(v, 1) for v in values], "text string, key int")
    found = [tuple(r) for r in split_overlap.edit_pairs(side(left), side(right), k).collect()]
    wanted = {(a, b) for a, b in product(left, right) if a and b and _distance(a, b) <= k}
    assert set(found) == wanted and len(found) == len(wanted)


def test_edit_pairs_of_exchanged_characters(spark):
    rng = random.Random(9)
    base = [f"{rng.getrandbits(64):016x}" for _ in range(300)]
    other = ["".join(c if rng.random() > 0.12 else rng.choice("0123456789abcdef") for c in s) for s in base]
    side = lambda values: spark.createDataFrame([(v,) for v in values], "text string")
    found = {tuple(r) for r in split_overlap.edit_pairs(side(base), side(other), 3, shift=0, agree=2).collect()}
    close = {(a, b) for a, b in product(base, other) if sum(x != y for x, y in zip(a, b, strict=True)) <= 3}
    assert close and close <= found
    with pytest.raises(ValueError):
        split_overlap.edit_pairs(side(base), side(other), 3, agree=2)


def _overlap_tables(spark):
    rng = random.Random(7)
    ids = [f"s{i}" for i in range(120)]
    assigned = {(m, i, rng.random() < 0.6) for m in "ab" for i in ids} | {("a", "s0", True), ("a", "s0", False)}
    number = {i: rng.choice([0xFFFF, 0xFFFE, 0xF0FF]) if rng.random() < 0.2 else rng.getrandbits(63) for i in ids}
    values = {(i, "content", f"d{rng.randrange(80)}") for i in ids} | {(i, "cluster", "hot" if rng.random() < 0.3 else i) for i in ids} | {(i, "perceptual", f"{number[i]:016X}") for i in ids} | {("s0", "content", "d1"), ("s1", "content", "d1")}

    def same(how, x, y):
        return (int(x, 16) ^ int(y, 16)).bit_count() <= 3 if how == "perceptual" else x == y

    tables = spark.createDataFrame(sorted(assigned), "manifest string, sample_id string, in_train boolean"), spark.createDataFrame([*sorted(values), ("s9", "cluster", None)], "sample_id string, how string, text string")
    pairs = {(m, e, t, how, x, y) for m, e, et in assigned if not et for n, t, tt in assigned if tt and m == n and e != t for i, how, x in values if i == e for j, h, y in values if j == t and h == how and same(how, x, y)}
    return tables, pairs


def test_overlaps_and_links(spark):
    (assigned, values), pairs = _overlap_tables(spark)
    found = [tuple(r) for r in split_overlap.overlaps(assigned, values).collect()]
    assert set(found) == {p[:3] for p in pairs} and len(found) == len(set(found))
    counted: dict = {}
    for m, e, _, how, _, _ in pairs:
        counted[m, how, e] = counted.get((m, how, e), 0) + 1
    assert {(r["manifest"], r["how"], r["e_id"]): r["links"] for r in split_overlap.links(assigned, values).collect()} == counted
    assert split_overlap.overlaps(assigned.limit(0), values).count() == 0


def test_components(spark):
    rng = random.Random(11)
    edges = [(f"n{a}", f"n{a + 1}") for a in range(40)] + [(f"m{rng.randrange(60)}", f"m{rng.randrange(60)}") for _ in range(50)] + [(None, "n1")]
    df = spark.createDataFrame([*edges, *edges[:5]], "a string, b string")
    found = {r["node"]: r["component"] for r in group_splits.components(df, Workspace(spark, "t5")).collect()}
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert found == {x: find(x) for x in root}


def test_splits_keep_components_and_stay(spark):
    sizes = spark.createDataFrame([(f"c{i}", 1) for i in range(3000)], "component string, n bigint")
    ratios = {"train": 0.8, "validation": 0.1, "calibration": 0.1, "none": 0.0}
    split = {r["component"]: r["split"] for r in group_splits.assign_splits(sizes, ratios, "s").collect()}
    share = {s: sum(v == s for v in split.values()) / 3000 for s in ratios}
    assert all(abs(share[s] - r) < 0.03 for s, r in ratios.items())
    heavy = sizes.unionByName(spark.createDataFrame([("big", 10**6)], sizes.schema))
    again = {r["component"]: r["split"] for r in group_splits.assign_splits(heavy, ratios, "s").collect()}
    assert all(again[c] == s for c, s in split.items())
    with pytest.raises(ValueError):
        group_splits.assign_splits(sizes, {"train": 0.5}, "s")


def test_torn_groups(spark):
    ws = Workspace(spark, "t5")
    membership = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("b", "g2"), ("c", "g2"), ("d", "g3"), ("e", "g3")], "key string, grp string")
    assignments = spark.createDataFrame([("m", "a", "train"), ("m", "b", "train"), ("m", "c", "validation"), ("m", "d", "train"), ("m", "x", "train"), ("n", "d", "train"), ("n", "d", "validation")], "manifest string, key string, split string")
    of_group = group_splits.group_components(membership, ws)
    assert {tuple(r) for r in of_group.collect()} == {("g1", "g1"), ("g2", "g1"), ("g3", "g3")}
    assert {tuple(r) for r in group_splits.torn_groups(assignments, membership, of_group).collect()} == {("m", "g2"), ("n", "g3")}
