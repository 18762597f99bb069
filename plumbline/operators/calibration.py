"""Platt calibration: two fits of a scale and a bias.

Both fits see a row only as (feature, label), so equal rows are first combined into
weights on the cluster; the iteration then runs in one task on distinct pairs. Where
features are so continuous that these are more than ROWS_IN_TASK, the rows stay on the
cluster and every step is one small aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import bce_of_logit, sigmoid
from plumbline.shipping import by_value

STEPS, RATE = 2000, 0.03
RIDGE, MOST_STEPS, TOLERANCE, LEAST_SCALE, HALVINGS = 1e-8, 100, 1e-10, 1e-12, 60
_FIT = "scale double, bias double"


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def fit_balanced(feature: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Gradient descent on the log of the scale and the bias, each class weighing one half."""
    if not (label == 0).any() or not (label == 1).any():
        raise ValueError("both classes are needed")
    half = np.where(label == 1, 0.5 / weight[label == 1].sum(), 0.5 / weight[label == 0].sum()) * weight

    def pull(scale: float, bias: float) -> tuple[float, float]:
        error = half * (_sigmoid(scale * feature + bias) - label)
        return float(error @ feature), float(error.sum())

    return descend(pull)


def descend(pull: Callable[[float, float], tuple[float, float]], steps: int = STEPS) -> tuple[float, float]:
    """Gradient steps from scale 1 and bias 0; ``pull`` gives the derivatives by the scale and the bias."""
    log_scale = bias = 0.0
    for _ in range(steps):
        scale = math.exp(log_scale)
        down, aside = pull(scale, bias)
        log_scale = min(6.0, max(-6.0, log_scale - RATE * down * scale))
        bias = min(20.0, max(-20.0, bias - RATE * aside))
    return math.exp(log_scale), bias


def _usable(a: float, b: float, norm: float) -> tuple[float, float]:
    """Scale and bias for the logits as they were before they were divided by ``norm``."""
    scale = a / norm
    if not math.isfinite(scale) or scale <= 0:
        raise ValueError("no usable scale")
    return scale, b


def newton(moments: Callable[[float, float], tuple], objective: Callable[[float, float], float]) -> tuple[float, float]:
    """Newton's method with step halving for a ridge-regularised logistic fit; returns scale and bias.

    ``moments`` gives gradient (2) and Hessian (3) of the mean loss, ``objective`` the
    loss with its ridge.
    """
    a, b = 1.0, 0.0
    for _ in range(MOST_STEPS):
        ga, gb, haa, hab, hbb = moments(a, b)
        ga, gb, haa, hbb = ga + RIDGE * a, gb + RIDGE * b, haa + RIDGE, hbb + RIDGE
        if max(abs(ga), abs(gb)) <= TOLERANCE:
            break
        det = haa * hbb - hab * hab
        if not math.isfinite(det) or det <= 0:
            raise ValueError("the Hessian is singular")
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        now, step = objective(a, b), 1.0
        for _ in range(HALVINGS):
            na, nb = a - step * da, b - step * db
            if na >= LEAST_SCALE and objective(na, nb) < now:
                a, b = na, nb
                break
            step /= 2
        else:
            break
    return a, b


def fit_newton(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The regularised maximum likelihood fit, logits being brought into [-1, 1] first."""
    if not (label == 0).any() or not (label == 1).any():
        raise ValueError("both classes are needed")
    norm = max(1.0, float(np.abs(logit).max()))
    u, w = logit / norm, weight / weight.sum()

    def moments(a: float, b: float) -> tuple:
        p = _sigmoid(a * u + b)
        r, v = w * (p - label), w * p * (1 - p)
        return float(r @ u), float(r.sum()), float(v @ (u * u)), float(v @ u), float(v.sum())

    def objective(a: float, b: float) -> float:
        z = a * u + b
        return float(w @ (np.maximum(z, 0) - z * label + np.log1p(np.exp(-np.abs(z))))) + RIDGE / 2 * (a * a + b * b)

    return _usable(*newton(moments, objective), norm)


#: Up to so many distinct (feature, label) rows are fitted in one task; more stay on the cluster.
ROWS_IN_TASK = 2_000_000


def fitted(df: DataFrame, feature: str, method: str, rows_in_task: int = ROWS_IN_TASK) -> DataFrame:
    """One row (scale, bias); ``method`` is 'balanced' or 'newton'. Both ways of computing use all rows and agree to rounding."""
    fit = {"balanced": fit_balanced, "newton": fit_newton}[method]
    combined = df.groupBy(F.col(feature).alias("x"), F.col("label").alias("y")).agg(F.count("*").alias("w"))
    if combined.limit(rows_in_task + 1).count() > rows_in_task:
        found = {"balanced": balanced_distributed, "newton": newton_distributed}[method](df, feature)
        return df.sparkSession.createDataFrame([found], _FIT)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y"])
        scale, bias = fit(rows["x"].to_numpy(float), rows["y"].to_numpy(float), rows["w"].to_numpy(float))
        return pd.DataFrame({"scale": [scale], "bias": [bias]})

    return combined.groupBy().applyInPandas(solve, _FIT)


def _class_sizes(df: DataFrame) -> dict[int, int]:
    sizes = {r["label"]: r["count"] for r in df.where("label in (0, 1)").groupBy("label").count().collect()}  # two rows
    if len(sizes) < 2:
        raise ValueError("both classes are needed")
    return sizes


def balanced_distributed(df: DataFrame, feature: str, steps: int = STEPS) -> tuple[float, float]:
    """As the 'balanced' fit, with both sums of every step taken on the cluster, over columns kept in memory or on disk."""
    sizes = _class_sizes(df)
    half = F.when(F.col("y") == 1, 0.5 / sizes[1]).otherwise(0.5 / sizes[0])
    rows = df.select(F.col(feature).cast("double").alias("x"), F.col("label").alias("y")).withColumn("half", half).persist()

    def pull(scale: float, bias: float) -> tuple[float, float]:
        error = F.col("half") * (sigmoid(F.lit(scale) * F.col("x") + F.lit(bias)) - F.col("y"))
        return tuple(rows.agg(F.sum(error * F.col("x")), F.sum(error)).first())

    try:
        return descend(pull, steps)
    finally:
        rows.unpersist()


def newton_distributed(df: DataFrame, feature: str) -> tuple[float, float]:
    """As the 'newton' fit, with every sum taken on the cluster: about two small jobs a step."""
    _class_sizes(df)
    norm = max(1.0, df.agg(F.max(F.abs(feature))).first()[0] or 0.0)
    u, y = F.col(feature) / norm, F.col("label").cast("double")

    def moments(a: float, b: float) -> tuple:
        p = sigmoid(a * u + b)
        v = p * (1 - p)
        return tuple(df.agg(F.avg((p - y) * u), F.avg(p - y), F.avg(v * u * u), F.avg(v * u), F.avg(v)).first())

    def objective(a: float, b: float) -> float:
        return df.agg(F.avg(bce_of_logit(a * u + b, y))).first()[0] + RIDGE / 2 * (a * a + b * b)

    return _usable(*newton(moments, objective), norm)


by_value()
