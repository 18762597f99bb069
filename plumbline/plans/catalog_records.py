"""Queries over records, exclusions, paths, pictures and results; the rest of the catalog is in ``catalog``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import numeric, paths
from plumbline.functions.compare import category
from plumbline.functions.hashing import content_digest
from plumbline.operators import leakage, metrics, selection, validate
from plumbline.operators import page_images as pages
from plumbline.plans import dialect, views
from plumbline.plans.catalog import DIGITS, PAGE, SEED, query
from plumbline.shipping import by_value
from plumbline.session import Workspace
from plumbline.sources import documents, shards
from plumbline.sources.predictions import prediction_rules
from plumbline.sources.tables import table

BASE, DATASET, REVISION = "https://host.example", "audit/mirage set", "0123456789abcdef" * 2 + "01234567"
#: Names that no table has.
STRANGERS = ("food/0_real/nowhere.png", "zoo/0_real/nothing.png")

# Scans and raw records


@query('SELECT "__key__" AS key, source, license, CAST(octet_length(thumbnail) AS BIGINT) AS bytes FROM monet_rows')
def scan_projected(spark: SparkSession, d: str) -> DataFrame:
    rows = shards.read_raw(spark, f"{d}/monet_rows.parquet")
    return rows.select(F.col("__key__").alias("key"), "source", "license", F.octet_length("thumbnail").cast("bigint").alias("bytes"))


@query("SELECT file_name, content_type, CASE label WHEN '0_real' THEN 0 WHEN '1_fake' THEN 1 END AS label FROM mirage_rows")
def metadata_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mirage_rows", "file_name", "content_type", "label")
    return rows.withColumn("label", F.when(F.col("label") == "0_real", 0).when(F.col("label") == "1_fake", 1))


_RAW = f"""rw AS (SELECT mo.*, 'shards/' || source AS upstream_path, t AS content_sha256 FROM mo JOIN (SELECT "__key__" AS key, min(sha256(thumbnail)) AS t FROM monet_rows GROUP BY 1) USING (key)),
sr AS (SELECT 'monet:' || key AS sample_id, 'monet-' || source AS source_id, upstream_path || '/' || key || '.webp' AS upstream_path, 'images/' || CASE label WHEN 1 THEN 'ai' ELSE 'real' END || '/' || source || '/' || content_sha256 || '.webp' AS local_path,
 label, content_sha256, 'monet:sscd:' || sscd_cluster_id AS provenance_group, generator_family, 'mixed' AS content_type, hash_sha256 AS upstream_sha256 FROM rw JOIN ct USING (source))"""


@query("SELECT * FROM sr", views.MONET, views.CONTRACTS_SQL, _RAW)
def sample_records(spark: SparkSession, d: str) -> DataFrame:
    """P1 and J10: the sample record of every approved row."""
    contents = table(spark, d, "monet_rows", "__key__", "thumbnail").groupBy(F.col("__key__").alias("key")).agg(F.min(content_digest("thumbnail")).alias("content_sha256"))
    rows = views.monet(spark, d).join(contents, "key").withColumn("upstream_path", F.concat(F.lit("shards/"), "source"))
    return shards.sample_records(rows, views.contracts(spark))


@query("SELECT sv.* FROM sv JOIN av USING (sample_id) WHERE manifest = 'sm-harbour' AND split = 'validation'", views.SAMPLES, views.ASSIGNMENTS)
def samples_for_split(spark: SparkSession, d: str) -> DataFrame:
    chosen = views.assignments(spark, d).where("manifest = 'sm-harbour' and split = 'validation'")
    return views.samples(spark, d).join(chosen.select("sample_id"), "sample_id")


@query(f"SELECT file_name, label, {views.GENERATOR_SQL} AS generator_family FROM mirage_rows WHERE file_name IS NOT NULL")
def generator_family(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mirage_rows", "file_name", "label").where("file_name is not null")
    return rows.withColumn("generator_family", paths.generator_of(F.col("file_name"), F.col("label")))


_ALLOWED = ", ".join(f"'{x}'" for x in validate.ALLOWED_LICENCES)
_SPDX = "CASE lower(license) " + " ".join(f"WHEN '{x.lower()}' THEN '{x}'" for x in validate.ALLOWED_LICENCES) + " END"


@query(f'SELECT "__key__" AS key, license, coalesce(source IS NOT NULL AND {_SPDX} IN ({_ALLOWED}), FALSE) AS allowed FROM monet_rows')
def license_allowed(spark: SparkSession, d: str) -> DataFrame:
    """A delivery with a source is taken as one whose audit says 'allow'."""
    spdx = F.lit(None).cast("string")
    for name in validate.ALLOWED_LICENCES:
        spdx = F.when(F.lower("license") == name.lower(), name).otherwise(spdx)
    decision = F.when(F.col("source").isNotNull(), "allow").otherwise("deny")
    return table(spark, d, "monet_rows", "__key__", "source", "license").select(F.col("__key__").alias("key"), "license", validate.license_allowed(decision, spdx).alias("allowed"))


def _where(spark: SparkSession, d: str, column: str, broken) -> DataFrame:
    return table(spark, d, "samples", *dict.fromkeys(("sample_id", column))).where(broken(F.col(column))).select("sample_id", F.col(column).alias("value"))


@query("SELECT sample_id, content_sha256 AS value FROM samples WHERE coalesce(NOT regexp_full_match(content_sha256, '[0-9a-f]{64}'), TRUE)")
def bad_digests(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "content_sha256", paths.not_a_digest)


@query("SELECT sample_id, upstream_path AS value FROM samples WHERE coalesce((upstream_path = '' OR starts_with(upstream_path, '/') OR contains(upstream_path, chr(92)) OR list_has_any(string_split(upstream_path, '/'), ['', '.', '..'])) AND upstream_path <> '.', TRUE)")
def unsafe_paths(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "upstream_path", paths.unsafe_path)


@query(f"SELECT sample_id, sample_id AS value FROM samples WHERE coalesce(sample_id = '' OR {dialect.trim('sample_id')} <> sample_id, TRUE)")
def untrimmed(spark: SparkSession, d: str) -> DataFrame:
    return _where(spark, d, "sample_id", paths.untrimmed)


@query("SELECT 'duplicate sample_id' AS rule, sample_id AS key FROM samples WHERE sample_id IS NOT NULL GROUP BY sample_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(table(spark, d, "samples", "sample_id"), ["sample_id"])


@query("SELECT 'duplicate file_name' AS rule, file_name AS key FROM mirage_rows WHERE file_name IS NOT NULL GROUP BY file_name HAVING count(*) > 1")
def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(table(spark, d, "mirage_rows", "file_name"), ["file_name"])


@query("SELECT 'source' AS rule, vec_id::VARCHAR AS key FROM embeddings WHERE label = 3 UNION ALL SELECT 'probability_ai', vec_id::VARCHAR FROM embeddings WHERE embedding[1] < 0")
def prediction_violations(spark: SparkSession, d: str) -> DataFrame:
    """The row contract of predictions, on vectors of which one class lacks its source and negative numbers stand for probabilities."""
    v = table(spark, d, "embeddings", "vec_id", "label", "embedding")
    first = F.element_at("embedding", 1).cast("double")
    none = F.lit(None).cast("string")
    p = F.when(first < 0, first).otherwise(F.least(first, F.lit(1.0)))
    rows = v.select(F.col("vec_id").cast("string").alias("sample_id"), F.when(F.col("label") != 3, "s").alias("source"), (F.col("label") % 2).alias("label"), p.alias("probability_ai"), none.alias("content_sha256"), none.alias("provenance_group"), none.alias("generator_family"))
    return validate.broken_rules(rows, F.col("sample_id"), prediction_rules())


_USED = [("", "Conv"), ("", "Gelu"), ("ai.custom", "Conv"), ("", ""), ("", "Where"), ("", "Gelu")]


@query(f"SELECT DISTINCT domain, operator FROM (VALUES {', '.join(map(str, _USED))}) u(domain, operator) WHERE domain <> '' OR operator NOT IN ({', '.join(map(repr, validate.GRAPH_OPERATORS))})")
def unsupported_ops(spark: SparkSession, d: str) -> DataFrame:
    return validate.unsupported_operators(spark.createDataFrame(_USED, "domain string, operator string"))


@query("SELECT name FROM (SELECT split_manifest_id AS name, dataset_manifest_sha256 AS a, CASE WHEN split_manifest_id = 'sm-quarry' THEN reverse(dataset_manifest_sha256) ELSE dataset_manifest_sha256 END AS b FROM split_manifests) WHERE a <> b UNION ALL SELECT 'other'")
def lineage_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Manifests against a list in which one digest is turned round and one name is new."""
    expected = table(spark, d, "split_manifests", "split_manifest_id", "dataset_manifest_sha256").toDF("name", "digest")
    changed = expected.withColumn("digest", F.when(F.col("name") == "sm-quarry", F.reverse("digest")).otherwise(F.col("digest")))
    return validate.lineage_mismatch(expected, changed.unionByName(spark.createDataFrame([("other", "0")], "name string, digest string")))


# Exclusions and sets

_SLICE = f"SELECT file_name FROM (SELECT DISTINCT file_name FROM mv) ORDER BY {dialect.digest(repr(SEED), repr('dev'), 'file_name')}, file_name LIMIT 40"
_EXCLUDED = f"ex AS (SELECT file_name FROM ({_SLICE}) UNION SELECT file_name FROM mv WHERE label = '0_real' AND content_type = 'food' UNION SELECT * FROM (VALUES {', '.join(f'({x!r})' for x in STRANGERS)}))"


@query(_SLICE, views.MIRAGE)
def dev_slice(spark: SparkSession, d: str) -> DataFrame:
    return selection.hash_slice(views.mirage(spark, d), "file_name", 40, SEED, "dev")


@query("SELECT file_name FROM ex", views.MIRAGE, _EXCLUDED)
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    """The slice, what a prior holdout had, and two names that are unknown."""
    prior = views.mirage(spark, d).where("label = '0_real' and content_type = 'food'").select("file_name")
    strangers = spark.createDataFrame([(x,) for x in STRANGERS], "file_name string")
    return dev_slice(spark, d).unionByName(prior).unionByName(strangers).distinct()


@query("SELECT file_name, label, content_type FROM mv WHERE file_name NOT IN (SELECT file_name FROM ex)", views.MIRAGE, _EXCLUDED)
def eligible_rows(spark: SparkSession, d: str) -> DataFrame:
    return selection.eligible(views.mirage(spark, d), exclusions(spark, d), "file_name").select("file_name", "label", "content_type")


@query("SELECT file_name FROM ex WHERE file_name NOT IN (SELECT file_name FROM mv)", views.MIRAGE, _EXCLUDED)
def unknown_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return validate.unknown_keys(exclusions(spark, d), "file_name", views.mirage(spark, d))


_LEAK = (views.SAMPLES, views.ASSIGNMENTS, views.TRAINING)


@query("SELECT DISTINCT content_sha256 FROM tr WHERE content_sha256 IN (SELECT content_sha256 FROM ho) ORDER BY 1 LIMIT 3", *_LEAK)
def prior_overlap(spark: SparkSession, d: str) -> DataFrame:
    training, holdout = views.training_and_holdouts(spark, d)
    return leakage.prior_overlap(holdout, training)


@query("SELECT sample_id FROM tr INTERSECT SELECT sample_id FROM ho", *_LEAK)
def shared_keys(spark: SparkSession, d: str) -> DataFrame:
    training, holdout = views.training_and_holdouts(spark, d)
    return training.select("sample_id").intersect(holdout.select("sample_id"))


_QUARRY = "qa AS (SELECT sample_id, split FROM av WHERE manifest = 'sm-quarry'), fk AS (SELECT sample_id FROM sv WHERE label = 1)"


@query("SELECT fk.sample_id, coalesce(split, 'missing') AS problem FROM fk LEFT JOIN qa USING (sample_id) WHERE split IS NULL OR split <> 'calibration'", views.SAMPLES, views.ASSIGNMENTS, _QUARRY)
def calibration_assignment_check(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the second class as predictions that should all be of the calibration split."""
    ids = views.samples(spark, d).where("label = 1")
    return leakage.assignment_check(ids, views.assignments(spark, d).where("manifest = 'sm-quarry'"), "calibration")


@query("SELECT 'missing' AS side, sample_id FROM (SELECT sample_id FROM qa WHERE split = 'calibration' EXCEPT SELECT sample_id FROM fk) UNION ALL SELECT 'extra', sample_id FROM (SELECT sample_id FROM fk EXCEPT SELECT sample_id FROM qa WHERE split = 'calibration')", views.SAMPLES, views.ASSIGNMENTS, _QUARRY)
def partition_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return leakage.set_difference(views.assignments(spark, d).where("manifest = 'sm-quarry' and split = 'calibration'"), views.samples(spark, d).where("label = 1"), "sample_id")


@query("SELECT 'missing' AS side, local_path FROM (SELECT local_path FROM samples WHERE batch_id <= 6 EXCEPT SELECT local_path FROM samples WHERE batch_id >= 5) UNION ALL SELECT 'extra', local_path FROM (SELECT local_path FROM samples WHERE batch_id >= 5 EXCEPT SELECT local_path FROM samples WHERE batch_id <= 6)")
def file_set_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files of the first six batches against those of the last six; a null path is a value here, as in SQL sets."""
    files = table(spark, d, "samples", "local_path", "batch_id").withColumn("local_path", F.coalesce("local_path", F.lit("\x00")))
    found = leakage.set_difference(files.where("batch_id <= 6"), files.where("batch_id >= 5"), "local_path")
    return found.withColumn("local_path", F.nullif("local_path", F.lit("\x00")))


# Paths and documents

_CLEAN = "trim(regexp_replace({0}, '[^A-Za-z0-9._ -]+', '_', 'g'), ' .')"
_SUFFIX = "lower(regexp_extract(file_name, '[^/](\\.[^./]+)$', 1))"


@query(f"SELECT file_name, CASE label WHEN '1_fake' THEN 'ai' ELSE 'real' END || '/' || {_CLEAN.format('content_type')} || CASE WHEN generator_family IS NULL THEN '' ELSE '/' || {_CLEAN.format('generator_family')} END || '/' || {dialect.digest(repr(SEED), 'file_name')} || CASE WHEN {_SUFFIX} IN ({', '.join(map(repr, paths.SUFFIXES))}) THEN {_SUFFIX} ELSE '.img' END AS path FROM mv", views.MIRAGE)
def entry_paths(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return views.mirage(spark, d).select("file_name", paths.entry_path(c("file_name"), c("label"), c("content_type"), c("generator_family"), SEED).alias("path"))


@query(f"SELECT file_name, '{BASE}/datasets/{DATASET.replace(' ', '%20')}/resolve/{REVISION}/' || replace(url_encode(file_name), '%2F', '/') AS url FROM mv", views.MIRAGE)
def pinned_url(spark: SparkSession, d: str) -> DataFrame:
    return views.mirage(spark, d).select("file_name", paths.pinned_url(BASE, F.lit(DATASET), F.lit(REVISION), F.col("file_name")).alias("url"))


_JSON = """sha256('{"samples":[' || string_agg('{"label":' || label || ',"sample_id":"' || sample_id || '","source_id":"' || source_id || '"}', ',' ORDER BY sample_id) || '],"schema_version":1}' || chr(10))"""


@query(f"SELECT {_JSON} AS digest FROM sv", views.SAMPLES)
def manifest_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = views.samples(spark, d).select("sample_id", "source_id", "label")
    return spark.createDataFrame([(documents.rows_digest(rows, {"schema_version": 1}, "samples", "sample_id"),)], "digest string")


@query("""SELECT split, sha256('{"sample_ids":[' || string_agg('"' || sample_id || '"', ',' ORDER BY sample_id) || '],"schema_version":1,"split":"' || split || '"}' || chr(10)) AS digest FROM av WHERE manifest = 'sm-quarry' AND split IN ('validation', 'calibration') GROUP BY split""", views.ASSIGNMENTS)
def partition_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = views.assignments(spark, d).where("manifest = 'sm-quarry'").select("sample_id", "split")
    return spark.createDataFrame([(s, documents.partition_digest(rows, s)) for s in ("validation", "calibration")], "split string, digest string")


# Numbers


@query(f"SELECT avg(CASE WHEN label = 1 AND probability_ai >= {numeric.THRESHOLD} THEN 1e0 WHEN label = 1 THEN 0e0 END) / 2 + avg(CASE WHEN label = 0 AND probability_ai < {numeric.THRESHOLD} THEN 1e0 WHEN label = 0 THEN 0e0 END) / 2 AS balanced_accuracy FROM pv", views.PREDICTIONS)
def ba_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.balanced_accuracy(views.predictions(spark, d), F.col("probability_ai"))


@query(f"SELECT round(sum(validation_bce * epoch) / sum(epoch), {DIGITS}) AS mean FROM cp", views.CHECKPOINTS)
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    return metrics.weighted_mean(views.checkpoints(spark, d), "validation_bce", "epoch").select(F.round("mean", DIGITS).alias("mean"))


@query("SELECT source_id, CAST(ceil(n / 32) AS BIGINT) AS steps_per_epoch, CAST(ceil(n / 32) AS BIGINT) * 30 AS total_steps, CAST(floor(CAST(ceil(n / 32) AS BIGINT) * 30 * CAST(0.05 AS DOUBLE)) AS BIGINT) AS warmup_steps FROM (SELECT source_id, count(*) AS n FROM sv GROUP BY 1)", views.SAMPLES)
def step_plan(spark: SparkSession, d: str) -> DataFrame:
    sizes = views.samples(spark, d).groupBy("source_id").agg(F.count("*").alias("n"))
    return sizes.select("source_id", *numeric.step_plan(F.col("n"), 32, 30, 0.05))


# Pictures and results


@query("SELECT key, bytes, width, height, bytes BETWEEN 1 AND 20971520 AND width BETWEEN 1 AND 8192 AND height BETWEEN 1 AND 8192 AND width * height <= 16777216 AS allowed FROM pc", views.PICTURES_SQL)
def image_limits(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return views.pictures(spark, d).select("key", "bytes", "width", "height", pages.within_limits(c("bytes"), c("width"), c("height")).alias("allowed"))


@query("SELECT key, CAST(greatest(1, round(width * f)) AS BIGINT) AS scaled_width, CAST(greatest(1, round(height * f)) AS BIGINT) AS scaled_height, (384 - CAST(greatest(1, round(width * f)) AS BIGINT)) / 2 AS offset_x, (384 - CAST(greatest(1, round(height * f)) AS BIGINT)) / 2 AS offset_y FROM (SELECT *, 440e0 / least(width, height) AS f FROM pc WHERE width > 0 AND height > 0)", views.PICTURES_SQL)
def resize_geometry(spark: SparkSession, d: str) -> DataFrame:
    return views.pictures(spark, d).where("width > 0 and height > 0").select("key", *numeric.resize_geometry(F.col("width"), F.col("height")))


_CHANNELS = ", ".join(f"({i}, {m}e0, {s}e0)" for i, (m, s) in enumerate(zip(pages.MEAN, pages.DEVIATION, strict=True)))


@query(f"SELECT key, CAST(c * 4 + p AS INT) AS place, round((CAST('0x' || substr(digest, CAST(2 * (p * 4 + c) + 1 AS INT), 2) AS INT) / 255e0 - m) / s, 4) AS value FROM pc, range(4) r(p), (VALUES {_CHANNELS}) ch(c, m, s)", views.PICTURES_SQL)
def normalize_pixels(spark: SparkSession, d: str) -> DataFrame:
    """The first 16 bytes of a picture's digest as four RGBA pixels."""
    rows = views.pictures(spark, d).select("key", F.unhex(F.substring("digest", 1, 32)).alias("rgba"))
    return pages.planar_pixels(rows, ["key"]).select("key", F.posexplode("pixels").alias("place", "value")).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("SELECT page_id, pos, source FROM pe", views.PAGE_IMAGES)
def canonical_source(spark: SparkSession, d: str) -> DataFrame:
    return pages.elements(views.page_images(spark, d)).select("page_id", "pos", "source")


_PLAN = """pp AS (SELECT page_id, source, min(pos) AS first_pos, count(*) AS elements FROM pe WHERE source IS NOT NULL GROUP BY 1, 2),
 pl AS (SELECT page_id, source, row_number() OVER (PARTITION BY page_id ORDER BY first_pos, source) AS place FROM pp),
 rs AS (SELECT *, CASE WHEN NOT starts_with(source, '""" + PAGE + """') THEN 'IMAGE_ORIGIN_NOT_ALLOWED' END AS code FROM pl)"""


def _gated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    images = views.page_images(spark, d)
    plan = Workspace(spark, "gated").put(pages.image_plan(images), "plan")  # read three times
    gate = paths.origin_gate(F.col("source"), F.lit(PAGE))
    marked = plan.withColumn("gate", gate)
    allowed = marked.where("gate = 'allow'").select("page_id", "id", F.lit("ok").alias("status"))
    blocked = marked.where("gate <> 'allow'").select("page_id", "id", F.lit("error").alias("status"), F.col("gate").alias("code"))
    return images, plan, pages.merge_results(plan.select("page_id", "id"), allowed, blocked)


@query("SELECT page_id, 'image-' || place AS id, place, CASE WHEN code IS NULL THEN 'ok' ELSE 'error' END AS status, code FROM rs", views.PAGE_IMAGES, _PLAN)
def merge_results(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d)[2].select("page_id", "id", "place", "status", "code")


@query("SELECT page_id, pos, 'image-' || place AS id, CASE WHEN code IS NULL THEN 'ok' ELSE 'error' END AS status FROM pe JOIN rs USING (page_id, source)", views.PAGE_IMAGES, _PLAN)
def fanout_results(spark: SparkSession, d: str) -> DataFrame:
    return pages.fan_out(*_gated(spark, d))


_HTML = """'<p>one<IMG class=x src="https://' || "__key__" || '.example/a.webp?x=1&amp;y=2" alt="' || coalesce(batch_id::VARCHAR, '') || '"><img alt=none></p>'"""


@query("""SELECT "__key__" AS page_id, pos, CASE pos WHEN 0 THEN 'https://' || "__key__" || '.example/a.webp?x=1&y=2' ELSE '' END AS src, CASE pos WHEN 0 THEN coalesce(batch_id::VARCHAR, '') ELSE 'none' END AS alt FROM monet_rows, range(2) r(pos) WHERE "__key__" IS NOT NULL""")
def html_images(spark: SparkSession, d: str) -> DataFrame:
    """S14 over pages written around the deliveries: two img elements each, one of them without a source."""
    html = F.concat(F.lit('<p>one<IMG class=x src="https://'), "__key__", F.lit('.example/a.webp?x=1&amp;y=2" alt="'), F.coalesce(F.col("batch_id").cast("string"), F.lit("")), F.lit('"><img alt=none></p>'))
    rows = table(spark, d, "monet_rows", "__key__", "batch_id").where("`__key__` is not null").select(F.col("__key__").alias("page_id"), html.alias("html"))
    return pages.html_images(rows).select("page_id", "pos", "src", "alt")


def _failing_scorer():
    def scorer(batch: pd.DataFrame) -> list[tuple]:
        out = []
        for v in batch["vec_id"]:
            if v % 7 == 0:
                raise ValueError("  bad Tensor shape ")
            if v % 11 == 0:
                raise ValueError(" ")
            out.append(("ok", 0.5, None, None))
        return out

    return scorer


@query(f"SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN NULL ELSE 5e-1 END AS confidence, CASE WHEN vec_id % 7 = 0 THEN 'IMAGE_DECODE_FAILED' WHEN vec_id % 11 = 0 THEN 'MODEL_INFERENCE_FAILED' END AS code, CASE WHEN vec_id % 7 = 0 THEN 'bad Tensor shape' WHEN vec_id % 11 = 0 THEN '{paths.NO_MESSAGE}' END AS message FROM embeddings")
def score_with_errors(spark: SparkSession, d: str) -> DataFrame:
    """X3: rows that make the scorer fail cost only themselves."""
    return pages.score(table(spark, d, "embeddings", "vec_id"), ["vec_id"], lambda: _failing_scorer())


by_value()
