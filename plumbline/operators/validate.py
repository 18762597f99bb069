"""Constraints. Each gives the rows that break it as (rule, key); ``require_empty`` turns them into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.paths import not_a_digest, unsafe_path, untrimmed

#: What a licence audit may allow (fixed values).
ALLOWED_LICENCES = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "MIT")


class ContractError(ValueError):
    """Data that break a constraint."""


def license_allowed(decision: Column, spdx: Column) -> Column:
    """Whether an audit allows a source: it says so, and the licence is on the list."""
    return F.coalesce((decision == "allow") & spdx.isin(*ALLOWED_LICENCES), F.lit(False))


#: Operators that an exported graph may use (fixed values).
GRAPH_OPERATORS = (
    "Add", "BatchNormalization", "Cast", "Clip", "Concat", "Constant", "ConstantOfShape", "Conv", "Div", "Erf", "Expand", "Flatten",
    "Gather", "Gemm", "GlobalAveragePool", "Identity", "LayerNormalization", "Log", "MatMul", "Mul", "Pad", "Pow", "ReduceMean", "ReduceL2",
    "Reshape", "Resize", "Shape", "Sigmoid", "Slice", "Sqrt", "Squeeze", "Sub", "Transpose", "Unsqueeze", "Where",
)


def unsupported_operators(used: DataFrame) -> DataFrame:
    """(domain, operator): distinct operators of ``used`` that have a domain, are blank or aren't on the list."""
    known = (F.col("domain") == "") & F.col("operator").isin(*GRAPH_OPERATORS)
    return used.where(~F.coalesce(known, F.lit(False))).select("domain", "operator").distinct()


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises with the first violation, if there is any. Looks at one row only."""
    row = violations.limit(1).collect()
    if row:
        raise ContractError(f"{what}: {row[0].asDict()}")


def broken_rules(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """One scan for all rules: (rule, key) wherever a rule's column is true."""
    marks = F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()])
    return df.select(key.cast("string").alias("key"), F.explode(F.array_compact(marks)).alias("rule")).select("rule", "key")


def sample_rules() -> dict[str, Column]:
    """The row contract of a sample record."""
    c = F.col
    return {
        "sample_id": untrimmed(c("sample_id")),
        "source_id": untrimmed(c("source_id")),
        "provenance_group": untrimmed(c("provenance_group")),
        "content_type": untrimmed(c("content_type")),
        "upstream_path": unsafe_path(c("upstream_path")),
        "local_path": unsafe_path(c("local_path")),
        "label": F.coalesce(~c("label").isin(0, 1), F.lit(True)),
        "content_sha256": not_a_digest(c("content_sha256")),
        "upstream_sha256": c("upstream_sha256").isNotNull() & not_a_digest(c("upstream_sha256")),
        "generator_family": (c("label") == 1) & untrimmed(c("generator_family")),
    }


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rule, key): values of any of the columns that occur more than once. One shuffle for all columns."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f"duplicate {c}").alias("rule"), F.col(c).cast("string").alias("key")) for c in columns]))
    return df.select(pairs.alias("x")).select("x.*").where("key is not null").groupBy("rule", "key").agg(F.count("*").alias("n")).where("n > 1").select("rule", "key")


def unknown_keys(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Values of ``column`` that ``known`` lacks."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().join(known.select(column).distinct(), column, "left_anti")


def class_presence(df: DataFrame) -> DataFrame:
    """One row: the number of records of each class and whether both are there."""
    n = lambda y: F.coalesce(F.sum((F.col("label") == y).cast("int")), F.lit(0)).cast("bigint")
    return df.agg(n(0).alias("real"), n(1).alias("ai")).withColumn("both", (F.col("real") > 0) & (F.col("ai") > 0))


def result_violations(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(rule, key): results that don't answer the requests one to one or are malformed."""
    found = duplicates(results, ["id"])
    found = found.unionByName(results.select("id").distinct().join(requests.select("id"), "id", "left_anti").select(F.lit("unknown id").alias("rule"), F.col("id").alias("key")))
    found = found.unionByName(requests.select("id").join(results.select("id"), "id", "left_anti").select(F.lit("missing id").alias("rule"), F.col("id").alias("key")))
    c = F.col
    confident = F.coalesce(c("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False))
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    rules = {
        "status": F.coalesce(~c("status").isin("ok", "error"), F.lit(True)),
        "ok": (c("status") == "ok") & (~confident | c("code").isNotNull() | c("message").isNotNull()),
        "error": (c("status") == "error") & (c("confidence").isNotNull() | blank(c("code")) | blank(c("message"))),
    }
    return found.unionByName(broken_rules(results, c("id"), rules))


def lineage_mismatch(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name): digests by name that differ or that one side lacks."""
    both = expected.alias("e").join(actual.alias("a"), "name", "full_outer")
    return both.where(~F.col("e.digest").eqNullSafe(F.col("a.digest"))).select("name")
