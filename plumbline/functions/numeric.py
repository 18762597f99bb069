"""Numeric column functions of evaluation, calibration and training plans."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 0.65
CLIP = 1e-6


def logit(p: Column) -> Column:
    """ln(q / (1 - q)) with q the probability clipped away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0 - CLIP))
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z) without overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def platt_of_probability(p: Column, scale: float | Column, bias: float | Column) -> Column:
    return platt_of_logit(logit(p), scale, bias)


def platt_of_logit(z: Column, scale: float | Column, bias: float | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return sigmoid(as_column(scale) * z + as_column(bias))


def bce_of_logit(z: Column, y: Column) -> Column:
    """The binary cross entropy of one logit."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def logit_cutoff(threshold: float = THRESHOLD) -> float:
    return math.log(threshold / (1.0 - threshold))


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Linear rise to ``warmup``, then half a cosine down to 0 at ``total``."""
    if not 0 <= warmup < total:
        raise ValueError("warmup must lie below total")
    at = F.least(step, F.lit(total)).cast("double")
    fall = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * (at - warmup) / float(total - warmup)))
    return F.when(at < warmup, at / float(warmup)).otherwise(fall) if warmup else fall


def step_plan(rows: Column, batch: int, epochs: int, warmup_share: float) -> list[Column]:
    """Steps an epoch, steps in all and steps of the warm-up, which are rounded down."""
    each = F.ceil(rows / F.lit(float(batch))).cast("bigint")
    total = (each * epochs).cast("bigint")
    return [each.alias("steps_per_epoch"), total.alias("total_steps"), F.floor(total * F.lit(float(warmup_share))).cast("bigint").alias("warmup_steps")]


def resize_geometry(width: Column, height: Column, shorter: int = 440, crop: int = 384) -> list[Column]:
    """Scaled width and height, and the offsets of the centred crop."""
    factor = F.lit(float(shorter)) / F.least(width, height)
    w, h = (F.greatest(F.lit(1), F.round(side * factor)).cast("bigint") for side in (width, height))
    return [w.alias("scaled_width"), h.alias("scaled_height"), ((F.lit(crop) - w) / 2.0).alias("offset_x"), ((F.lit(crop) - h) / 2.0).alias("offset_y")]
