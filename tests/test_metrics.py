"""Metrics and calibration fits on the small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import numeric
from plumbline.operators import calibration, leakage, metrics
from plumbline.operators.validate import ContractError


def table(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_threshold_is_inclusive(spark):
    row = metrics.confusion(table(spark, [(0, 0.10), (0, 0.80), (1, 0.65), (1, 0.64)]), F.col("score")).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"], row["balanced_accuracy"]) == (1, 1, 1, 1, 0.5)


def test_balanced_accuracy(spark):
    df = table(spark, [(0, 0.2), (0, 0.7), (1, 0.65), (1, 0.9)])
    assert metrics.balanced_accuracy(df, F.col("score")).first()[0] == 0.75
    for bad in ([(0, 0.2)], [(0, 0.1), (2, 0.2)], [(0, math.nan), (1, 0.2)], [(0, math.inf), (1, 0.2)], [(None, 0.1), (1, 0.2)]):
        with pytest.raises(ContractError):
            metrics.balanced_accuracy(table(spark, bad), F.col("score"))
    with pytest.raises(ValueError):
        metrics.balanced_accuracy(df, F.col("score"), 1.0)
    with pytest.raises(ValueError):
        metrics.frozen_threshold(0.5)


def test_empty_and_one_class(spark):
    row = metrics.confusion(table(spark, []), F.col("score")).first()
    assert row["count"] == row["tp"] == 0 and row["balanced_accuracy"] is None
    assert metrics.confusion(table(spark, [(1, 0.9)]), F.col("score")).first()["tnr"] is None
    assert metrics.auc(table(spark, [(1, 0.9)]), "score").first()[0] is None


def test_by_source_takes_the_overall_rate_for_a_missing_class(spark):
    rows = [("a", 0, 0.1), ("a", 0, 0.9), ("b", 1, 0.9), ("c", 0, 0.1), ("c", 1, 0.1)]
    found = {r["source"]: r for r in metrics.by_source(spark.createDataFrame(rows, "source string, label int, score double"), F.col("score")).collect()}
    assert found["a"]["tpr"] is None and found["a"]["balanced_accuracy"] == (0.5 + 0.5) / 2
    assert found["b"]["balanced_accuracy"] == pytest.approx((2 / 3 + 1) / 2) and found["c"]["balanced_accuracy"] == 0.5


@pytest.mark.parametrize(("rows", "wanted"), [([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], 1.0), ([(0, 0.5), (1, 0.5)], 0.5), ([(0, 0.9), (1, 0.1)], 0.0)])
def test_auc(spark, rows, wanted):
    assert metrics.auc(table(spark, rows), "score").first()[0] == wanted


def test_auc_with_ties_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.randrange(12) / 4) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wanted = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.auc(table(spark, rows), "score").first()[0] == pytest.approx(wanted)


def test_cross_entropy_and_sigmoid_of_extremes(spark):
    df = table(spark, [(1, 1e308), (0, -1e308), (1, 0.0)])
    z = F.col("score")
    assert df.agg(metrics.cross_entropy(df, z)).first()[0] == pytest.approx(math.log(2) / 3)
    assert sorted(r[0] for r in df.select(numeric.sigmoid(z)).collect()) == [0.0, 0.5, 1.0]


def test_calibration_error_has_15_bins(spark):
    df = table(spark, [(1, 1.0), (1, 14 / 15), (0, 0.0), (0, math.nextafter(1 / 15, 0))])
    bins = {r["bin"]: r["n"] for r in metrics.reliability(df, F.col("score")).collect()}
    assert bins == {14: 2, 0: 2}
    assert metrics.calibration_error(df, F.col("score")).first()[0] == pytest.approx((1 / 15 + 1 / 15) / 4)


def test_weighted_mean(spark):
    df = spark.createDataFrame([(1.0, 1), (4.0, 2), (None, 0)], "v double, w int")
    assert metrics.weighted_mean(df, "v", "w").first()[0] == 3.0
    assert metrics.weighted_mean(df.limit(0), "v", "w").first()[0] is None


def _scores(spark):
    rng = random.Random(4)
    rows = [(y, rng.gauss(2.0 * y - 1, 1.5)) for y in (rng.randrange(2) for _ in range(300))]
    return rows, table(spark, rows)


def test_newton_is_the_same_in_one_task_and_on_the_cluster(spark):
    _, df = _scores(spark)
    one, spread = (calibration.fitted(df, "score", "newton", n).first() for n in (10**6, 10))
    assert tuple(spread) == pytest.approx(tuple(one), rel=1e-9) and one["scale"] > 0


def test_gradient_steps_are_the_same_in_one_task_and_on_the_cluster(spark):
    rows, df = _scores(spark)
    size = [sum(y == c for y, _ in rows) for c in (0, 1)]

    def pull(scale, bias):
        errors = [(0.5 / size[y] * (1 / (1 + math.exp(-(scale * x + bias))) - y), x) for y, x in rows]
        return sum(e * x for e, x in errors), sum(e for e, _ in errors)

    assert calibration.balanced_distributed(df, "score", 25) == pytest.approx(calibration.descend(pull, 25), rel=1e-9)
    assert tuple(calibration.fitted(df, "score", "balanced").first()) == pytest.approx(calibration.descend(pull), rel=1e-6)


@pytest.mark.parametrize("method", ["balanced", "newton"])
@pytest.mark.parametrize("rows_in_task", [1, 10**6])
def test_fits_need_both_classes(spark, method, rows_in_task):
    df = table(spark, [(1, 0.5), (1, 0.6), (1, 0.7)])
    with pytest.raises(Exception, match="both classes are needed"):
        calibration.fitted(df, "score", method, rows_in_task).collect()


def test_a_scale_must_be_usable():
    assert calibration._usable(4.0, 1.0, 2.0) == (2.0, 1.0)
    for a in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(ValueError):
            calibration._usable(a, 0.0, 1.0)


HOLDOUT = "holdout_id string, holdout_order bigint, file_name string, content_sha256 string, provenance_group string"
TRAINING = "sample_id string, upstream_path string, content_sha256 string, upstream_sha256 string, provenance_group string"


def test_leaks_in_order(spark):
    training = spark.createDataFrame([("t1", "p/1.png", "c1", "u1", "g1"), ("t2", "p/2.png", "c2", None, "g2")], TRAINING)
    make = lambda *rows: spark.createDataFrame(rows, HOLDOUT)
    clean = ("h", 0, "x.png", "cx", "gx")
    assert leakage.first_leak(training, make(clean)).count() == 0
    for row, check, value in ((("h", 0, "p/1.png", "c1", "g1"), "id", "p/1.png"), (("h", 0, "x", "u1", "g1"), "content", "u1"), (("h", 0, "x", None, "g2"), "provenance", "g2"), (("h", 0, "t2", "c2", ""), "id", "t2")):
        found = leakage.first_leak(training, make(clean, row)).first()
        assert (found["check_name"], found["value"]) == (check, value)
    two = leakage.first_leak(training, make(("second", 1, "t1", "", ""), ("first", 0, "x", "", "g2"))).first()
    assert (two["holdout_id"], two["check_name"]) == ("first", "provenance")
    with pytest.raises(ValueError):
        leakage.first_leak(training, make())


def test_overlaps_and_assignments(spark):
    a = spark.createDataFrame([("x", "c1"), ("y", "c2"), (None, None)], "sample_id string, content_sha256 string")
    b = spark.createDataFrame([("x", "c9"), ("z", "c2"), (None, None)], a.schema)
    assert {tuple(r) for r in leakage.shared_preview(a, b, ["sample_id", "content_sha256"]).collect()} == {("sample_id", 1, "x"), ("content_sha256", 1, "c2")}
    assert [r[0] for r in leakage.prior_overlap(a, b).collect()] == ["c2"]
    split = spark.createDataFrame([("x", "calibration"), ("y", "train")], "sample_id string, split string")
    ids = spark.createDataFrame([("x",), ("y",), ("w",)], "sample_id string")
    assert {tuple(r) for r in leakage.assignment_check(ids, split, "calibration").collect()} == {("y", "train"), ("w", "missing")}
    assert {tuple(r) for r in leakage.set_difference(ids, split, "sample_id").collect()} == {("missing", "w")}
