"""Parquet shards of a source: ranking, reading, parsing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import joined_digest
from plumbline.functions.paths import not_a_digest

#: The columns of a raw shard (fixed values).
RAW_COLUMNS = ("__key__", "hash_sha256", "hash_perceptual", "sscd_cluster_id", "source", "license", "thumbnail")


def ranked_shards(paths: DataFrame, seed: str, n: int) -> DataFrame:
    """(path): the first n shard paths by hash. ``paths`` has one row per file."""
    digest = joined_digest(seed, "shard", F.col("path"))
    return paths.where("path is not null").distinct().orderBy(digest, "path").limit(n)


def pick_shards(spark: SparkSession, paths: Iterable[str], seed: str, n: int) -> list[str]:
    """As ``ranked_shards`` for a list of files on the driver; too few files are an error."""
    named = sorted({p for p in paths if p.endswith(".parquet")})
    if len(named) < n:
        raise ValueError(f"{len(named)} shards where {n} are wanted")
    return [r["path"] for r in ranked_shards(spark.createDataFrame([(p,) for p in named], "path string"), seed, n).collect()]


def read_raw(spark: SparkSession, *paths: str) -> DataFrame:
    """The seven raw columns of shards and the file that each row came from."""
    return spark.read.parquet(*paths).select(*[f"`{c}`" for c in RAW_COLUMNS], F.col("_metadata.file_name").alias("shard"))


def parse_rules(expected_source: str | None = None, approved: tuple[str, ...] = ()) -> dict:
    """What makes a raw row unusable, by rule."""
    rules = {f"{c} missing": F.col(f"`{c}`").isNull() for c in RAW_COLUMNS}
    rules["thumbnail empty"] = F.octet_length("thumbnail") == 0
    rules["hash_sha256 malformed"] = F.col("hash_sha256").isNotNull() & not_a_digest(F.col("hash_sha256"))
    if expected_source is not None:
        rules["other source"] = F.col("source") != expected_source
    if approved:
        rules["source not approved"] = ~F.col("source").isin(*approved)
    return rules


def sample_records(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """The sample record of every raw row of an approved source; rows of other sources have none.

    ``rows``: key, source, upstream_path, content_sha256, hash_sha256 and sscd_cluster_id;
    ``contracts``: a row per source with its label and generator_family.
    """
    known = rows.join(contracts.select("source", "label", "generator_family"), "source")
    folder = F.when(F.col("label") == 1, "ai").otherwise("real")
    return known.select(
        F.concat(F.lit("monet:"), "key").alias("sample_id"), F.concat(F.lit("monet-"), "source").alias("source_id"),
        F.concat("upstream_path", F.lit("/"), "key", F.lit(".webp")).alias("upstream_path"), F.concat(F.lit("images/"), folder, F.lit("/"), "source", F.lit("/"), "content_sha256", F.lit(".webp")).alias("local_path"),
        "label", "content_sha256", F.concat(F.lit("monet:sscd:"), "sscd_cluster_id").alias("provenance_group"), "generator_family", F.lit("mixed").alias("content_type"), F.col("hash_sha256").alias("upstream_sha256"),
    )
