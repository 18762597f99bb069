"""Predictions of a classifier in their two forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.paths import not_a_digest, untrimmed

PROBABILITY_SCHEMA = "sample_id string, label int, probability_ai double, source string, content_sha256 string, provenance_group string, generator_family string"
LOGIT_SCHEMA = "sample_id string, raw_logit double, label int"


def bad_probability(p: Column) -> Column:
    """NaN first: it counts as greater than every number."""
    return F.coalesce(F.isnan(p) | ~p.between(0.0, 1.0), F.lit(True))


def prediction_rules() -> dict[str, Column]:
    """The row contract of a probability prediction. The digest is checked after lowering but compared as written."""
    optional = {c: F.col(c).isNotNull() & untrimmed(F.col(c)) for c in ("provenance_group", "generator_family")}
    return {
        "sample_id": untrimmed(F.col("sample_id")),
        "source": untrimmed(F.col("source")),
        "label": F.coalesce(~F.col("label").isin(0, 1), F.lit(True)),
        "probability_ai": bad_probability(F.col("probability_ai")),
        "content_sha256": F.col("content_sha256").isNotNull() & not_a_digest(F.lower("content_sha256")),
        **optional,
    }
