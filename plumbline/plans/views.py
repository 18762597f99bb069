"""Clean views of the driver's dirty tables, as DataFrames and as SQL.

The selection and split operators fail on rows that break a contract, so the views give
them one row per record: the smallest value of each column among a record's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.compare import category, digest, key_text
from plumbline.functions.numeric import sigmoid
from plumbline.functions.paths import generator_of
from plumbline.plans.dialect import cat, key, sha
from plumbline.plans.dialect import sigmoid as sql_sigmoid
from plumbline.sources.tables import table

#: The four sources that are approved, with label, licence and generator (fixed values).
CONTRACTS = {
    "commoncatalog-cc-by": (0, "cc-by-4.0", None),
    "synthetic-flux-schnell": (1, "apache-2.0", "flux-1-schnell"),
    "synthetic-flux-klein": (1, "apache-2.0", "flux-2-klein-4b"),
    "synthetic-z-image": (1, "apache-2.0", "z-image"),
}


def samples(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "samples")
    rows = raw.select(
        key_text("sample_id").alias("sample_id"), category("source_id").alias("source_id"), "upstream_path", "local_path", "label", digest("content_sha256").alias("content_sha256"),
        key_text("provenance_group").alias("provenance_group"), category("generator_family").alias("generator_family"), category("content_type").alias("content_type"), digest("upstream_sha256").alias("upstream_sha256"),
    )
    columns = [c for c in rows.columns if c != "sample_id"]
    one = rows.where("sample_id is not null").groupBy("sample_id").agg(*[F.min(c).alias(c) for c in columns])
    return one.where("source_id is not null and label is not null and content_sha256 is not null and provenance_group is not null")


SAMPLES = f"""sv AS (SELECT {key('sample_id')} AS sample_id, min({cat('source_id')}) AS source_id, min(upstream_path) AS upstream_path, min(local_path) AS local_path, min(label) AS label, min({sha('content_sha256')}) AS content_sha256,
 min({key('provenance_group')}) AS provenance_group, min({cat('generator_family')}) AS generator_family, min({cat('content_type')}) AS content_type, min({sha('upstream_sha256')}) AS upstream_sha256
 FROM samples GROUP BY 1 HAVING {key('sample_id')} IS NOT NULL AND min({cat('source_id')}) IS NOT NULL AND min(label) IS NOT NULL AND min({sha('content_sha256')}) IS NOT NULL AND min({key('provenance_group')}) IS NOT NULL)"""


def one_label(df: DataFrame) -> DataFrame:
    """Without the groups that carry both labels."""
    from plumbline.operators.splitting import conflicting_groups

    return df.join(conflicting_groups(df), "provenance_group", "left_anti")


ONE_LABEL = "ol AS (SELECT * FROM sv WHERE provenance_group NOT IN (SELECT provenance_group FROM sv GROUP BY 1 HAVING min(label) <> max(label)))"


def mirage(spark: SparkSession, d: str) -> DataFrame:
    """Files whose name agrees with their label: (file_name, label, content_type, generator_family)."""
    rows = table(spark, d, "mirage_rows").where("file_name is not null").groupBy("file_name").agg(F.min("label").alias("label"), F.min(category("content_type")).alias("content_type"))
    named = rows.withColumn("generator_family", generator_of(F.col("file_name"), F.col("label")))
    return named.where("content_type is not null and (label = '0_real' or generator_family is not null)")


GENERATOR_SQL = "CASE WHEN label = '1_fake' AND len(string_split(file_name, '/')) >= 4 AND string_split(file_name, '/')[2] = '1_fake' AND string_split(file_name, '/')[3] <> '' THEN string_split(file_name, '/')[3] END"

MIRAGE = f"""mr AS (SELECT file_name, min(label) AS label, min({cat('content_type')}) AS content_type FROM mirage_rows WHERE file_name IS NOT NULL GROUP BY 1),
mv AS (SELECT *, CASE WHEN label = '1_fake' AND len(string_split(file_name, '/')) >= 4 AND string_split(file_name, '/')[2] = '1_fake' AND string_split(file_name, '/')[3] <> '' THEN string_split(file_name, '/')[3] END AS generator_family FROM mr
 WHERE content_type IS NOT NULL AND (label = '0_real' OR (label = '1_fake' AND len(string_split(file_name, '/')) >= 4 AND string_split(file_name, '/')[2] = '1_fake' AND string_split(file_name, '/')[3] <> '')))"""


def monet(spark: SparkSession, d: str) -> DataFrame:
    """(key, source, hash_sha256, sscd_cluster_id, license) of approved sources, one row per key."""
    rows = table(spark, d, "monet_rows", "__key__", "source", "hash_sha256", "sscd_cluster_id", "license")
    one = rows.where("`__key__` is not null").groupBy(F.col("__key__").alias("key")).agg(F.min(category("source")).alias("source"), F.min(digest("hash_sha256")).alias("hash_sha256"), F.min("sscd_cluster_id").alias("sscd_cluster_id"), F.min(F.lower("license")).alias("license"))
    return one.where(F.col("source").isin(*CONTRACTS))


_NAMES = ", ".join(f"'{s}'" for s in CONTRACTS)
MONET = f"""mo AS (SELECT "__key__" AS key, min({cat('source')}) AS source, min({sha('hash_sha256')}) AS hash_sha256, min(sscd_cluster_id) AS sscd_cluster_id, min(lower(license)) AS license FROM monet_rows WHERE "__key__" IS NOT NULL GROUP BY 1 HAVING min({cat('source')}) IN ({_NAMES}))"""


def contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, *c) for s, c in CONTRACTS.items()], "source string, label int, expected_license string, generator_family string")


CONTRACTS_SQL = "ct(source, label, expected_license, generator_family) AS (VALUES " + ", ".join(f"('{s}', {c[0]}, '{c[1]}', {'NULL' if c[2] is None else repr(c[2])})" for s, c in CONTRACTS.items()) + ")"


def assignments(spark: SparkSession, d: str) -> DataFrame:
    """(manifest, sample_id, split): one row per manifest and sample, the smallest split."""
    rows = table(spark, d, "split_assignments").select(F.col("split_manifest_id").alias("manifest"), key_text("sample_id").alias("sample_id"), category("split").alias("split"))
    return rows.where("manifest is not null and sample_id is not null and split is not null").groupBy("manifest", "sample_id").agg(F.min("split").alias("split"))


ASSIGNMENTS = f"av AS (SELECT split_manifest_id AS manifest, {key('sample_id')} AS sample_id, min({cat('split')}) AS split FROM split_assignments WHERE split_manifest_id IS NOT NULL AND {key('sample_id')} IS NOT NULL AND {cat('split')} IS NOT NULL GROUP BY 1, 2)"


def training_and_holdouts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Training records of the first manifest, and the evaluation records of both as two holdouts."""
    s, a = samples(spark, d), assignments(spark, d)
    training = s.join(a.where("manifest = 'sm-harbour' and split = 'train'").select("sample_id"), "sample_id")
    held = s.join(a.where("split <> 'train'").select("sample_id", F.col("manifest").alias("holdout_id")), "sample_id")
    order = F.when(F.col("holdout_id") == "sm-quarry", 0).otherwise(1)
    return training, held.select("holdout_id", order.cast("bigint").alias("holdout_order"), F.col("upstream_path").alias("file_name"), "content_sha256", "provenance_group", "sample_id", "generator_family")


TRAINING = """tr AS (SELECT sv.* FROM sv JOIN av USING (sample_id) WHERE manifest = 'sm-harbour' AND split = 'train'),
ho AS (SELECT manifest AS holdout_id, CASE WHEN manifest = 'sm-quarry' THEN 0 ELSE 1 END AS holdout_order, upstream_path AS file_name, content_sha256, provenance_group, sample_id, generator_family FROM sv JOIN av USING (sample_id) WHERE split <> 'train')"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Logits and probabilities from the vectors; ten sources of one class each; ``part`` halves them."""
    v = table(spark, d, "embeddings")
    z = F.element_at("embedding", 1).cast("double") * 4.0
    rows = v.select(F.concat(F.lit("v:"), F.col("vec_id").cast("string")).alias("sample_id"), (F.col("label") % 2).alias("label"), z.alias("raw_logit"), F.concat(F.lit("cls"), F.col("label").cast("string")).alias("source"), F.when(F.col("label") % 4 < 2, "calibration").otherwise("holdout").alias("part"))
    return rows.withColumn("probability_ai", sigmoid(F.col("raw_logit")))


PREDICTIONS = f"""pz AS (SELECT 'v:' || vec_id AS sample_id, label % 2 AS label, CAST(embedding[1] AS DOUBLE) * 4e0 AS raw_logit, 'cls' || label AS source, CASE WHEN label % 4 < 2 THEN 'calibration' ELSE 'holdout' END AS part FROM embeddings),
pv AS (SELECT *, {sql_sigmoid('raw_logit')} AS probability_ai FROM pz)"""


def checkpoints(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "ts", "event_type", "value")
    epoch = F.dayofmonth("ts").alias("epoch")
    rows = e.groupBy(epoch).agg((F.avg("value") / 1000.0).alias("validation_bce"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("validation_balanced_accuracy"))
    return rows.select(F.concat(F.lit("epoch-"), F.lpad(F.col("epoch").cast("string"), 4, "0")).alias("checkpoint_id"), "epoch", (F.col("epoch") * 100).alias("global_step"), "validation_bce", "validation_balanced_accuracy")


CHECKPOINTS = "cp AS (SELECT 'epoch-' || lpad(CAST(day(ts) AS VARCHAR), 4, '0') AS checkpoint_id, day(ts) AS epoch, day(ts) * 100 AS global_step, avg(value) / 1000e0 AS validation_bce, avg(CASE WHEN event_type = 'purchase' THEN 1e0 ELSE 0e0 END) AS validation_balanced_accuracy FROM events GROUP BY day(ts))"


def page_images(spark: SparkSession, d: str) -> DataFrame:
    """Images of pages made from deliveries: a page per key prefix, redelivered keys being repeated sources.

    Null licences give an unsupported scheme, other spellings of the source an upper-case one.
    """
    rows = table(spark, d, "monet_rows", "__key__", "source", "license", "batch_id", "delivered_at").where("`__key__` is not null and source is not null and delivered_at is not null")
    scheme = F.when(F.col("license").isNull(), "ftp://").when(F.col("source") == F.upper("source"), "HTTPS://").otherwise("https://")
    src = F.concat(scheme, category("source"), F.lit(".example:443/"), "__key__", F.lit(".webp#b"), F.col("batch_id").cast("string"))
    return rows.select(F.split("__key__", "-")[0].alias("page_id"), F.unix_micros(F.col("delivered_at").cast("timestamp")).alias("pos"), F.lit("").alias("current_src"), src.alias("src"), F.concat(F.lit(" "), "source").alias("alt"), F.col("__key__").alias("key"))


_SOURCE = cat("source")
PAGE_IMAGES = f"""pi AS (SELECT string_split("__key__", '-')[1] AS page_id, epoch_us(delivered_at) AS pos, lower(CASE WHEN license IS NULL THEN 'ftp://' ELSE 'https://' END) || {_SOURCE} || '.example' || CASE WHEN license IS NULL THEN ':443' ELSE '' END || '/' || "__key__" || '.webp' AS whole,
 license IS NOT NULL AS supported, source AS raw, "__key__" AS key FROM monet_rows WHERE "__key__" IS NOT NULL AND source IS NOT NULL AND delivered_at IS NOT NULL),
pe AS (SELECT page_id, pos, CASE WHEN supported THEN whole END AS source, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS alt FROM pi)"""


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """(key, digest, bytes, width, height) of approved deliveries; the sides are read from the digest, as the tables have none."""
    side = lambda at: F.conv(F.substring("hash_sha256", at, 4), 16, 10).cast("bigint") % 9000
    size = table(spark, d, "monet_rows", "__key__", "thumbnail").where("`__key__` is not null").groupBy(F.col("__key__").alias("key")).agg(F.max(F.octet_length("thumbnail")).cast("bigint").alias("bytes"))
    rows = monet(spark, d).where("length(hash_sha256) = 64").join(size, "key")
    return rows.select("key", F.col("hash_sha256").alias("digest"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"), side(1).alias("width"), side(5).alias("height"))


PICTURES_SQL = f"""{MONET},
pc AS (SELECT key, hash_sha256 AS digest, coalesce(bytes, 0) AS bytes, CAST('0x' || substr(hash_sha256, 1, 4) AS BIGINT) % 9000 AS width, CAST('0x' || substr(hash_sha256, 5, 4) AS BIGINT) % 9000 AS height
 FROM mo JOIN (SELECT "__key__" AS key, CAST(max(octet_length(thumbnail)) AS BIGINT) AS bytes FROM monet_rows GROUP BY 1) USING (key) WHERE length(hash_sha256) = 64)"""
