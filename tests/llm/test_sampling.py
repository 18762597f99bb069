"""Problems 2, 3, 4 and 8 on small tables, against brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from plumbline.llm import mixing, nested_sample, quota_sample, top_items
from plumbline.session import Workspace


def test_bucket_list_only_grows(spark, tmp_path):
    buckets = nested_sample.BucketList(spark, f"file://{tmp_path}/buckets")
    assert buckets.upto() == 0
    assert [buckets.extend(n) for n in (1, 5, 3, 9, 9)] == [1, 5, 5, 9, 9]
    listed = {r["place"]: r["bucket"] for r in buckets.rows().collect()}
    assert sorted(listed) == list(range(9))
    assert all((b * nested_sample.STRIDE + nested_sample.OFFSET) % nested_sample.BUCKETS == p for p, b in listed.items())


def test_sample_is_the_same_however_rows_come_and_keeps_its_records(spark):
    keys = [("k", f"r{i}") for i in range(4000)]
    make = lambda rows: spark.createDataFrame(rows, "record_kind string, record_key string")
    take = lambda df, n: {r["record_key"] for r in nested_sample.nested_sample(df, n, "s").collect()}
    small = take(make([*keys[:2000], *keys[:50], ("k", None)]), 3000)
    assert small == take(make(keys[:2000][::-1]).repartition(7), 3000)
    assert small < take(make(keys), 3000) < take(make(keys), 6000)
    assert take(make([]), 3000) == set()
    n = nested_sample.size_for(make(keys), 300, "s", before=10)
    assert len(take(make(keys), n)) >= 300 > len(take(make(keys), n - 1))


def test_unstable_records(spark):
    rng = random.Random(2)
    draws = {(d, r, "k", f"x{i}") for d in range(1, 4) for r in range(1, 3) for i in range(40) if rng.random() < 0.9}
    rows = [*draws, *list(draws)[:20], (None, 1, "k", "x1"), (1, 1, None, "x1"), (1, 1, "k", None)]
    found = {r["record_key"] for r in nested_sample.unstable_records(spark.createDataFrame(rows, "draw_id int, run_no int, record_kind string, record_key string"), "s").collect()}
    runs = {(d, r) for d, r, _, _ in draws}
    has = lambda d, r, k: (d, r, "k", k) in draws
    wanted = {k for d, r, _, k in draws if any(not has(*run, k) for run in runs if run[0] > d or (run[0] == d and run[1] != r))}
    assert found == wanted and wanted


def test_top_items(spark):
    rng = random.Random(4)
    rows = [("g0" if rng.random() < 0.4 else f"g{rng.randrange(300)}", f"k{rng.randrange(2500)}", rng.choice([1.0, 2.0, 2.5, float("nan"), None, -0.0])) for _ in range(4000)]
    rows += [(None, "k", 1.0), ("g1", None, 1.0)]
    best: dict = {}
    for g, k, s in rows:
        if g and k and s is not None and s == s:
            best[g, k] = max(s, best.get((g, k), -9.0))
    groups: dict = {}
    for (g, k), s in best.items():
        groups.setdefault(g, []).append((-s, k))
    wanted = {(g, k, i + 1) for g, items in groups.items() if len(items) > 2 for i, (_, k) in enumerate(sorted(items)[:3])}
    df = spark.createDataFrame([(*r, 7) for r in rows], "g string, key string, score double, rank_ int")
    found = top_items.top_items(df, ["g"], 3, Workspace(spark, "t3"), more_than=2)
    assert {(r["g"], r["key"], r["rank"]) for r in found.collect()} == wanted
    assert top_items.top_items(df.limit(0), ["g"], 3, Workspace(spark, "t3")).count() == 0


def test_band_ranks_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("g", f"k{i}", float(i)) for i in range(100)], "g string, key string, score double")
    plan = top_items.top_items(df, ["g"], 3, Workspace(spark, "t3"))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def _targets(rows):
    columns = ["target_id", "target_set", "source_id", "generator_family", "content_type", "label", "target_share", "min_records", "sample_size", "available"]
    return pd.DataFrame(rows, columns=columns).astype({"min_records": "Int64", "sample_size": "Int64", "available": "Int64"})


def test_unmet_quota_goes_to_siblings_then_cousins():
    t = _targets([(1, "s", "a", "g", "x", 1, 0.4, 0, 10, 1), (2, "s", "a", "g", "y", 1, 0.2, 0, 10, 3), (3, "s", "a", "h", "x", 1, 0.2, 0, 10, 50), (4, "s", "b", None, "x", 0, 0.2, 0, 10, 50)])
    out = quota_sample.allocate(t).set_index("target_id")
    assert out["quota"].tolist() == [1, 3, 4, 2]  # one to the sibling, two to the cousin of the same source
    assert out["passed_on"].tolist() == [3, 0, 0, 0] and out.loc[1, "unmet"] == 3.0
    assert (out["unmet"] > 0).sum() == 1


def test_minima_nulls_and_too_little_supply():
    t = _targets([(1, "s", "a", None, "x", 0, 0.999, None, 10, 4), (2, "s", "b", None, "x", 0, 0.001, 3, 10, 2), (3, "s", "c", None, "x", 0, None, 0, 10, 0)])
    out = quota_sample.allocate(t).set_index("target_id")
    assert out["quota"].tolist() == [4, 2, 0]
    assert out["unmet"].tolist() == pytest.approx([5.99, 1.0, 0.0])


def test_draw_takes_the_quota_in_hash_order(spark):
    records = spark.createDataFrame([(f"r{i % 900}", "a", None, "x", 0) for i in range(1000)] + [(None, "a", None, "x", 0), ("n", "a", None, None, 0)], "key string, source_id string, generator_family string, content_type string, label int")
    targets = spark.createDataFrame([(1, "s", "a", None, "x", 0, 1.0, 0, 200)], "target_id int, target_set string, source_id string, generator_family string, content_type string, label int, target_share double, min_records bigint, sample_size bigint")
    quotas = quota_sample.allocation(quota_sample.supply(records, targets))
    drawn = [sorted(r["key"] for r in quota_sample.draw(df, targets, quotas, "s", Workspace(spark, "t4")).collect()) for df in (records, records.repartition(9))]
    assert drawn[0] == drawn[1] and len(set(drawn[0])) == len(drawn[0]) == 200


def test_poisson_limits():
    rng = np.random.default_rng(1)
    sizes = np.bincount(rng.integers(0, mixing.BINS, 3000), weights=rng.integers(1, 900, 3000), minlength=mixing.BINS).astype(np.int64)
    for rate, cap in ((0.02, 1), (0.3, 1), (0.9, 2), (2.5, 4), (3.99, 4)):
        wanted = rate * sizes.sum()
        limits = np.array(mixing.limits_for(sizes, wanted, cap))
        taken = sum(sizes[limit:].sum() for limit in limits)
        assert len(limits) == cap and (np.diff(limits) >= 0).all() and abs(taken - wanted) <= 2 * sizes.max()
    assert mixing.limits_for(sizes, 9e9, 3) == [0, 0, 0] and mixing.limits_for(sizes, 0, 2) == [mixing.BINS] * 2
    assert mixing.below(2.0, 3) == pytest.approx(np.cumsum([np.exp(-2), 2 * np.exp(-2), 2 * np.exp(-2)]))


def test_copies_of_old_documents_hardly_move(spark):
    items = spark.createDataFrame([(i, "a", 100) for i in range(2000)], "doc_id bigint, source string, size bigint")
    targets = spark.createDataFrame([("m", "a", 0.5, 3, 200_000), ("m", "b", 0.5, 3, 200_000), ("m", None, 0.5, 3, 1)], "mixture_id string, source string, target_share double, max_repeats int, budget bigint")
    planned = mixing.plan(items, targets, "s")
    copies = {r["doc_id"]: r["copies"] for r in mixing.replicate(items, planned, "s").collect()}
    more = items.unionByName(spark.createDataFrame([(9999, "a", 100)], items.schema))
    later = {r["doc_id"]: r["copies"] for r in mixing.replicate(more, mixing.plan(more, targets, "s"), "s").collect()}
    assert abs(sum(copies.values()) - 1000) <= 1 and max(copies.values()) <= 3
    assert sum(copies.get(i, 0) != later.get(i, 0) for i in range(2000)) <= 3
    rows = {r["source"]: r for r in mixing.shares(planned, mixing.replicate(items, planned, "s")).collect()}
    assert rows["a"]["short"] is False and rows["b"]["short"] is True and rows["b"]["taken"] == 0
    assert Counter(copies.values())[2] > 20  # some documents come twice


def test_mixing_skips_nulls_and_takes_empty_tables(spark):
    items = spark.createDataFrame([(1, "a", 10, "x"), (2, "a", 10, "y")], "doc_id bigint, source string, size bigint, available string")
    targets = spark.createDataFrame([("m", "a", 0.5, 2, 40), ("m", "b", None, 2, 40), (None, "a", 0.5, 2, 40), ("n", "a", 0.0, 0, 40)], "mixture_id string, source string, target_share double, max_repeats int, budget bigint")
    planned = mixing.plan(items.drop("available"), targets, "s")
    assert {(r["mixture_id"], r["source"], r["short"]) for r in planned.collect()} == {("m", "a", False), ("n", "a", False)}
    assert sum(r["size"] * r["copies"] for r in mixing.replicate(items.drop("available"), planned, "s").collect()) == 20
    assert mixing.shares(planned, mixing.replicate(items.drop("available").limit(0), planned, "s")).count() == 2
    assert mixing.plan(items.drop("available").limit(0), targets, "s").where("short").count() == 1
    assert mixing.plan(items.drop("available"), targets.limit(0), "s").count() == 0


def test_a_shuffled_mixture_is_the_same_however_rows_come(spark):
    rows = spark.createDataFrame([("m", "a", i, 5, 1 + i % 3) for i in range(50)], "mixture_id string, source string, doc_id bigint, size bigint, copies int")
    one = [tuple(r) for r in mixing.shuffled(rows, "s").collect()]
    assert one == [tuple(r) for r in mixing.shuffled(rows.repartition(7), "s").collect()] and len(one) == sum(1 + i % 3 for i in range(50))
    assert [r[2] for r in one] != sorted(r[2] for r in one)
