"""The reference's operators as named queries, and their SQL.

Fractions are rounded to ``DIGITS`` in both, as sums differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.compare import category
from plumbline.functions.hashing import content_digest, joined_digest
from plumbline.functions.numeric import THRESHOLD, logit, logit_cutoff, platt_of_logit, platt_of_probability, sigmoid, warmup_cosine
from plumbline.functions.paths import error_code as error_code_of
from plumbline.functions.paths import origin_gate as origin_gate_of
from plumbline.functions.paths import result_label as result_label_of
from plumbline.operators import calibration, leakage, metrics, selection, splitting, validate
from plumbline.operators import page_images as pages
from plumbline.operators.ranking import digest_rank
from plumbline.plans import dialect, views
from plumbline.session import Workspace
from plumbline.sources.predictions import bad_probability
from plumbline.sources.shards import parse_rules, ranked_shards
from plumbline.sources.tables import table
from plumbline.streaming.retention import retained

FLAGSHIP = "evaluate_holdout"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEED, DIGITS = "323", 8
TYPES = ["food", "portrait", "street"]
GENERATORS = ["ardent-xl", "quill-1", "lumen-2"]
QUOTAS = {"commoncatalog-cc-by": 60, "synthetic-flux-klein": 20, "synthetic-flux-schnell": 20, "synthetic-z-image": 20}
RATIOS = (0.8, 0.1, 0.1)
PAGE = "https://synthetic-flux-klein.example/"


def query(select: str | None = None, *ctes: str):
    """Registers a query and, if it has one, its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if select is not None:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {', '.join(ctes)}\n" if ctes else "") + select
        return f

    return add


def _near(c: str) -> Column:
    return F.round(F.col(c), DIGITS).alias(c)


def _b(c: str, name: str | None = None) -> str:
    return f"CAST({c} AS BIGINT) AS {name or c}"


# Evaluation and calibration

_CELLS = ", ".join(f"CAST(coalesce(sum(CASE WHEN label = {y} AND {'' if p else 'NOT '}hit THEN 1 ELSE 0 END), 0) AS BIGINT) AS {n}" for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))
_RATES = "tn / nullif(tn + fp, 0) AS tnr, tp / nullif(tp + fn, 0) AS tpr"
_HITS = f"hits AS (SELECT *, probability_ai >= {THRESHOLD} AS hit FROM pv)"
_ALL = f"every AS (SELECT count(*) AS count, {_CELLS} FROM hits), rated AS (SELECT *, {_RATES} FROM every)"
_EACH = f"each AS (SELECT source, count(*) AS count, {_CELLS} FROM hits GROUP BY source), filled AS (SELECT each.*, each.tn / nullif(each.tn + each.fp, 0) AS tnr, each.tp / nullif(each.tp + each.fn, 0) AS tpr, rated.tnr AS all_tnr, rated.tpr AS all_tpr FROM each, rated)"
_FILLED = "source, count, tn, fp, fn, tp, tnr, tpr, (coalesce(tnr, all_tnr) + coalesce(tpr, all_tpr)) / 2 AS balanced_accuracy"
_WHOLE = "count, tn, fp, fn, tp, tnr, tpr, (tnr + tpr) / 2 AS balanced_accuracy"
#: The class-balanced fit, step by step, on the calibration part.
_GD = f"""cal AS (SELECT {dialect.logit('probability_ai')} AS f, label AS y, 0.5e0 / count(*) OVER (PARTITION BY label) AS w FROM pv WHERE part = 'calibration'),
 gd(i, l, b) AS (SELECT 0, 0e0, 0e0 UNION ALL SELECT i + 1, least(6e0, greatest(-6e0, l - 3e-2 * dl)), least(20e0, greatest(-20e0, b - 3e-2 * db)) FROM
 (SELECT i, l, b, sum(w * ({dialect.sigmoid('(exp(l) * f + b)')} - y) * f * exp(l)) AS dl, sum(w * ({dialect.sigmoid('(exp(l) * f + b)')} - y)) AS db FROM gd, cal WHERE i < {calibration.STEPS} GROUP BY i, l, b)),
 fit AS (SELECT exp(l) AS scale, b AS bias FROM gd WHERE i = {calibration.STEPS})"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = views.predictions(spark, d)
    return rows.where("part = 'calibration'"), rows.where("part = 'holdout'")


def _fit(spark: SparkSession, d: str, method: str) -> DataFrame:
    rows, _ = _parts(spark, d)
    return calibration.fitted(rows.withColumn("f", logit(F.col("probability_ai")) if method == "balanced" else F.col("raw_logit")), "f", method)


_CALIBRATED = f"hits AS (SELECT pv.*, {dialect.sigmoid('(scale * ' + dialect.logit('probability_ai') + ' + bias)')} >= {THRESHOLD} AS hit FROM pv, fit WHERE part = 'holdout')"


@query(f"SELECT NULL AS source, {_WHOLE}, round(scale, {DIGITS}) AS scale, round(bias, {DIGITS}) AS bias FROM rated, fit UNION ALL SELECT {_FILLED}, round(scale, {DIGITS}), round(bias, {DIGITS}) FROM filled, fit", views.PREDICTIONS, _GD, _CALIBRATED, _ALL, _EACH)
def evaluate_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the holdout under the fit of the calibration part: over all (source null) and per source."""
    ws = Workspace(spark, "evaluate")
    fitting, holdout = (ws.put(df, name) for df, name in zip(_parts(spark, d), ("calibration", "holdout"), strict=True))
    for rows, name in ((fitting, "calibration"), (holdout, "holdout")):
        validate.require_empty(validate.duplicates(rows, ["sample_id"]), f"repeated in {name}")
    validate.require_empty(leakage.shared_preview(fitting, holdout, ["sample_id"]), "in calibration and holdout")
    fit = ws.put(calibration.fitted(fitting.withColumn("f", logit(F.col("probability_ai"))), "f", "balanced"), "fit")
    scored = holdout.crossJoin(F.broadcast(fit)).withColumn("p", platt_of_probability(F.col("probability_ai"), F.col("scale"), F.col("bias")))
    whole = metrics.confusion(scored, F.col("p"))
    validate.require_empty(whole.where("balanced_accuracy is null"), "both classes are needed")
    both = whole.select(F.lit(None).cast("string").alias("source"), "*").unionByName(metrics.by_source(scored, F.col("p")))
    return both.crossJoin(F.broadcast(fit.select(_near("scale"), _near("bias"))))


@query(f"SELECT {_WHOLE} FROM rated", views.PREDICTIONS, _HITS, _ALL)
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(views.predictions(spark, d), F.col("probability_ai"))


@query(f"SELECT {_WHOLE} FROM rated", views.PREDICTIONS, f"hits AS (SELECT *, raw_logit >= {logit_cutoff()!r} AS hit FROM pv)", _ALL)
def ba_logits(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(views.predictions(spark, d), F.col("raw_logit"), logit_cutoff())


@query(f"SELECT {_FILLED} FROM filled", views.PREDICTIONS, _HITS, _ALL, _EACH)
def by_source(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_source(views.predictions(spark, d), F.col("probability_ai"))


_AVERAGE = "SELECT raw_logit, count(*) AS ties, min(r) + (count(*) - 1) / 2 AS average_rank FROM (SELECT raw_logit, rank() OVER (ORDER BY raw_logit) AS r FROM pv) GROUP BY raw_logit"


@query(_AVERAGE, views.PREDICTIONS)
def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_ranks(views.predictions(spark, d), "raw_logit")


@query(f"SELECT round((sum(CASE WHEN label = 1 THEN average_rank END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), {DIGITS}) AS auc FROM pv JOIN ar USING (raw_logit)", views.PREDICTIONS, f"ar AS ({_AVERAGE})")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(views.predictions(spark, d), "raw_logit").select(_near("auc"))


@query(f"SELECT round(avg({dialect.bce('raw_logit', 'label')}), {DIGITS}) AS bce, avg(CASE WHEN (probability_ai >= {THRESHOLD}) = (label = 1) THEN 1e0 ELSE 0e0 END) AS accuracy FROM pv", views.PREDICTIONS)
def bce(spark: SparkSession, d: str) -> DataFrame:
    rows = views.predictions(spark, d)
    return rows.agg(F.round(metrics.cross_entropy(rows, F.col("raw_logit")), DIGITS).alias("bce"), metrics.accuracy(F.col("probability_ai")).alias("accuracy"))


_BINS = f"bins AS (SELECT CAST(least(floor(probability_ai * {metrics.BINS}), {metrics.BINS - 1}) AS BIGINT) AS bin, count(*) AS n, avg(probability_ai) AS mean_probability, avg(label) AS mean_label FROM pv GROUP BY 1)"


@query(f"SELECT bin, n, round(mean_probability, {DIGITS}) AS mean_probability, round(mean_label, {DIGITS}) AS mean_label FROM bins", views.PREDICTIONS, _BINS)
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.reliability(views.predictions(spark, d), F.col("probability_ai")).select("bin", "n", _near("mean_probability"), _near("mean_label"))


@query(f"SELECT round(sum(n * abs(mean_probability - mean_label)) / sum(n), {DIGITS}) AS ece FROM bins", views.PREDICTIONS, _BINS)
def ece(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_error(views.predictions(spark, d), F.col("probability_ai")).select(_near("ece"))


@query(f"SELECT round(scale, {DIGITS}) AS scale, round(bias, {DIGITS}) AS bias FROM fit", views.PREDICTIONS, _GD)
def platt_gd(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, "balanced").select(_near("scale"), _near("bias"))


#: The regularised fit: gradient, Hessian and the first of 60 halved steps that lowers the objective, until none does.
_S = dialect.sigmoid("(a * u + b)")
_NA, _NB = "(s.a - pow(5e-1, t) * s.da)", "(s.b - pow(5e-1, t) * s.db)"
_NEWTON = f"""nm AS (SELECT greatest(1e0, max(abs(raw_logit))) AS m FROM pv WHERE part = 'calibration'),
 nc AS (SELECT raw_logit / m AS u, CAST(label AS DOUBLE) AS y FROM pv, nm WHERE part = 'calibration'),
 nt(i, a, b, moving) AS (SELECT 0, 1e0, 0e0, TRUE UNION ALL
  SELECT i + 1, CASE WHEN small OR t IS NULL THEN a ELSE a - pow(5e-1, t) * da END, CASE WHEN small OR t IS NULL THEN b ELSE b - pow(5e-1, t) * db END, NOT small AND t IS NOT NULL FROM
  (SELECT s.*, (SELECT min(t) FROM (SELECT t, avg({dialect.bce(f'({_NA} * u + {_NB})', 'y')}) + 5e-9 * (pow({_NA}, 2) + pow({_NB}, 2)) AS o FROM range(60) r(t), nc GROUP BY t) WHERE {_NA} >= 1e-12 AND o < s.now) AS t FROM
   (SELECT i, a, b, now, greatest(abs(ga), abs(gb)) <= 1e-10 AS small, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db FROM
    (SELECT i, a, b, avg({dialect.bce('(a * u + b)', 'y')}) + 5e-9 * (a * a + b * b) AS now, avg(({_S} - y) * u) + 1e-8 * a AS ga, avg({_S} - y) + 1e-8 * b AS gb, avg({_S} * (1 - {_S}) * u * u) + 1e-8 AS haa, avg({_S} * (1 - {_S}) * u) AS hab, avg({_S} * (1 - {_S})) + 1e-8 AS hbb
     FROM nt, nc WHERE moving AND i < 100 GROUP BY i, a, b)) s)),
 nf AS (SELECT a / m AS scale, b AS bias FROM nt, nm ORDER BY i DESC LIMIT 1)"""
_STAGES = f"""sg AS (SELECT 'uncalibrated' AS stage, raw_logit AS z, label FROM pv WHERE part = 'calibration' UNION ALL SELECT 'calibrated', scale * raw_logit + bias, label FROM pv, nf WHERE part = 'calibration'),
 sp AS (SELECT *, {dialect.sigmoid('z')} AS p FROM sg),
 sb AS (SELECT stage, abs(avg(p) - avg(label)) * count(*) AS gap, count(*) AS n FROM sp GROUP BY stage, least(floor(p * {metrics.BINS}), {metrics.BINS - 1})),
 se AS (SELECT stage, sum(gap) / sum(n) AS ece FROM sb GROUP BY stage)"""


@query(f"SELECT round(scale, {DIGITS}) AS scale, round(bias, {DIGITS}) AS bias FROM nf", views.PREDICTIONS, _NEWTON)
def platt_newton(spark: SparkSession, d: str) -> DataFrame:
    return _fit(spark, d, "newton").select(_near("scale"), _near("bias"))


@query(f"SELECT stage, round(avg({dialect.bce('z', 'label')}), {DIGITS}) AS bce, any_value(round(ece, {DIGITS})) AS ece, avg(CASE WHEN (p >= {THRESHOLD}) = (label = 1) THEN 1e0 ELSE 0e0 END) AS accuracy FROM sp JOIN se USING (stage) GROUP BY stage", views.PREDICTIONS, _NEWTON, _STAGES)
def calibration_report(spark: SparkSession, d: str) -> DataFrame:
    """(stage, bce, ece, accuracy) of the calibration part before and after the Newton fit."""
    rows, _ = _parts(spark, d)
    fit = Workspace(spark, "report").put(_fit(spark, d, "newton"), "fit")
    after = rows.crossJoin(F.broadcast(fit)).withColumn("raw_logit", F.col("scale") * F.col("raw_logit") + F.col("bias"))
    out = None
    for stage, df in (("uncalibrated", rows), ("calibrated", after)):
        df = df.withColumn("p", sigmoid(F.col("raw_logit")))
        one = df.agg(F.round(metrics.cross_entropy(df, F.col("raw_logit")), DIGITS).alias("bce"), metrics.accuracy(F.col("p")).alias("accuracy"))
        one = one.crossJoin(metrics.calibration_error(df, F.col("p")).select(_near("ece"))).select(F.lit(stage).alias("stage"), "bce", "ece", "accuracy")
        out = one if out is None else out.unionByName(one)
    return out


_SCORES = f"""SELECT sample_id, round({dialect.logit('probability_ai')}, {DIGITS}) AS logit, round({dialect.sigmoid('raw_logit')}, {DIGITS}) AS sigmoid,
 round({dialect.sigmoid('(1.5e0 * ' + dialect.logit('probability_ai') + ' - 2.5e-1)')}, {DIGITS}) AS platt_apply, round({dialect.sigmoid('(1.5e0 * raw_logit - 2.5e-1)')}, {DIGITS}) AS platt_logit FROM pv"""


@query(_SCORES, views.PREDICTIONS)
def score_functions(spark: SparkSession, d: str) -> DataFrame:
    """F3 to F6: logit, sigmoid and both Platt transforms of every prediction."""
    p, z = F.col("probability_ai"), F.col("raw_logit")
    named = {"logit": logit(p), "sigmoid": sigmoid(z), "platt_apply": platt_of_probability(p, 1.5, -0.25), "platt_logit": platt_of_logit(z, 1.5, -0.25)}
    return views.predictions(spark, d).select("sample_id", *[F.round(c, DIGITS).alias(n) for n, c in named.items()])


@query(f"SELECT CAST(global_step AS BIGINT) AS step, round(CASE WHEN global_step < 300 THEN global_step / 300e0 ELSE 5e-1 * (1 + cos(pi() * (least(global_step, 3000) - 300) / 2700e0)) END, {DIGITS}) AS rate FROM cp", views.CHECKPOINTS)
def lr_schedule(spark: SparkSession, d: str) -> DataFrame:
    return views.checkpoints(spark, d).select(F.col("global_step").cast("bigint").alias("step"), F.round(warmup_cosine(F.col("global_step"), 300, 3000), DIGITS).alias("rate"))


# Selection

_BY_NAME = dialect.digest(f"'{SEED}'", "file_name")
_STRATUM = "file_name, label, content_type, generator_family, rank"
_TYPES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TYPES))
_GENERATORS = ", ".join(f"({j}, '{g}')" for j, g in enumerate(GENERATORS))


@query(f"SELECT {_STRATUM} FROM (SELECT *, row_number() OVER (PARTITION BY content_type, label ORDER BY {_BY_NAME}, file_name) AS rank FROM mv WHERE content_type IN {tuple(TYPES)}) WHERE rank <= 20", views.MIRAGE)
def balanced_strata(spark: SparkSession, d: str) -> DataFrame:
    return selection.balanced_strata(views.mirage(spark, d), TYPES, 20, SEED).select(*_STRATUM.split(", "))


@query(
    f"""SELECT {_STRATUM} FROM (SELECT mv.*, i, j, row_number() OVER (PARTITION BY content_type, label, CASE WHEN label = '1_fake' THEN generator_family END ORDER BY {_BY_NAME}, file_name) AS rank FROM mv JOIN ty ON t = content_type LEFT JOIN ge ON g = generator_family)
 WHERE (label = '0_real' AND rank <= 20) OR (label = '1_fake' AND j IS NOT NULL AND rank <= 20 // {len(GENERATORS)} + CASE WHEN ((j - i * (20 % {len(GENERATORS)})) % {len(GENERATORS)} + {len(GENERATORS)}) % {len(GENERATORS)} < 20 % {len(GENERATORS)} THEN 1 ELSE 0 END)""",
    views.MIRAGE, f"ty(i, t) AS (VALUES {_TYPES}), ge(j, g) AS (VALUES {_GENERATORS})",
)
def generator_strata(spark: SparkSession, d: str) -> DataFrame:
    return selection.generator_strata(views.mirage(spark, d), TYPES, GENERATORS, 20, SEED).select(*_STRATUM.split(", "))


def _quota_sql(rows: str, reserve: int) -> str:
    return f"SELECT source, key, rank FROM (SELECT source, key, quota, row_number() OVER (PARTITION BY source ORDER BY {dialect.digest(repr(SEED), 'source', 'key')}, key) AS rank FROM {rows} JOIN qu USING (source)) WHERE rank <= quota + {reserve}"


_QUOTAS = "qu(source, quota) AS (VALUES " + ", ".join(f"('{s}', {q})" for s, q in QUOTAS.items()) + ")"


@query(_quota_sql("mo", 0), views.MONET, _QUOTAS)
def source_quotas(spark: SparkSession, d: str) -> DataFrame:
    rows = Workspace(spark, "quotas").put(views.monet(spark, d), "rows")
    validate.require_empty(selection.quota_violations(rows, QUOTAS), "candidates")
    return selection.source_quotas(rows, QUOTAS, SEED).select("source", "key", "rank")


@query(_quota_sql("mo", 40), views.MONET, _QUOTAS)
def bounded_candidates(spark: SparkSession, d: str) -> DataFrame:
    return selection.source_quotas(views.monet(spark, d), QUOTAS, SEED, 40).select("source", "key", "rank")


@query(f"SELECT source, key FROM ({_quota_sql('st', 40)})", f"""st AS (SELECT DISTINCT {dialect.cat('source')} AS source, "__key__" AS key FROM monet_rows WHERE "__key__" IS NOT NULL)""", _QUOTAS)
def stream_topk(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of ``bounded_candidates``, kept while files arrive; each delivered spelling counts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table(spark, d, "monet_rows", "__key__", "source").schema)
    prepare = lambda batch: batch.select(category("source").alias("source"), F.col("__key__").alias("key"))
    return retained(spark, f"{d}/monet_row[s].parquet", schema, prepare, QUOTAS, SEED, Workspace(spark, "topk"), 40, redelivered=True)


@query("SELECT source, quota, coalesce(n, 0) AS available FROM qu LEFT JOIN (SELECT source, count(*) AS n FROM mo GROUP BY source) USING (source) WHERE coalesce(n, 0) < quota", views.MONET, f"qu(source, quota) AS (SELECT source, 100000::BIGINT FROM (VALUES {', '.join(f'({s!r})' for s in QUOTAS)}) v(source))")
def quota_shortfall(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(s, 100_000) for s in QUOTAS], "source string, quota bigint")
    return selection.shortfall(views.monet(spark, d), wanted, ["source"])


@query(f"SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY {dialect.digest(repr(SEED), 'sample_id')}, sample_id) AS rank FROM sv", views.SAMPLES)
def hash_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = views.samples(spark, d).select("sample_id", "label", joined_digest(SEED, F.col("sample_id")).alias("digest"))
    return digest_rank(rows, ["label"], "digest", ["sample_id"]).select("sample_id", "label", "rank")


@query(f"SELECT path FROM (SELECT DISTINCT source AS path FROM documents WHERE source IS NOT NULL) ORDER BY {dialect.digest(repr(SEED), repr('shard'), 'path')}, path LIMIT 5")
def shard_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranked_shards(table(spark, d, "documents", "source").withColumnRenamed("source", "path"), SEED, 5)


@query(f"SELECT doc_id, sha256(text) AS content_sha256, {dialect.digest(repr(SEED), 'doc_id')} AS rank_sha256, CASE WHEN contains(lower(text), 'tensor') OR contains(lower(text), 'decode') THEN 'IMAGE_DECODE_FAILED' ELSE 'MODEL_INFERENCE_FAILED' END AS error_code FROM documents")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """content digest, stable rank and error class of every text."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", content_digest("text").alias("content_sha256"), joined_digest(SEED, F.col("doc_id")).alias("rank_sha256"), error_code_of(F.col("text")).alias("error_code"))


# Splitting

_GROUPS = """gs AS (SELECT provenance_group, min(label) AS label, count(*) AS n, '(' || min(label) || ', (' || string_agg(DISTINCT '''' || source_id || '''', ', ' ORDER BY '''' || source_id || '''') || CASE WHEN count(DISTINCT source_id) = 1 THEN ',' ELSE '' END || '))' AS stratum FROM ol GROUP BY 1)"""
_COUNTS = f"""fr AS (SELECT stratum, count(*) AS groups, {', '.join(f'(count(*) - 3) * CAST({r!r} AS DOUBLE) AS r{i}' for i, r in enumerate(RATIOS))} FROM gs GROUP BY 1 HAVING count(*) >= 3),
 fp AS (SELECT stratum, groups, i, floor(r) AS base, row_number() OVER (PARTITION BY stratum ORDER BY r - floor(r) DESC, i) AS place, groups - 3 - sum(floor(r)) OVER (PARTITION BY stratum) AS spare FROM ({' UNION ALL '.join(f'SELECT stratum, groups, {i} AS i, r{i} AS r FROM fr' for i in range(3))})),
 sc AS (SELECT stratum, groups, {', '.join(f'CAST(sum(CASE WHEN i = {i} THEN base + 1 + CASE WHEN place <= spare THEN 1 ELSE 0 END END) AS BIGINT) AS {s}_groups' for i, s in enumerate(splitting.SPLITS))} FROM fp GROUP BY 1, 2)"""


def _one_label(spark: SparkSession, d: str) -> DataFrame:
    """Written once, as the operators look at it several times."""
    return Workspace(spark, "one-label").put(views.one_label(views.samples(spark, d)), "rows")


@query("SELECT provenance_group, label, stratum, n FROM gs", views.SAMPLES, views.ONE_LABEL, _GROUPS)
def split_strata(spark: SparkSession, d: str) -> DataFrame:
    return splitting.groups_of(views.samples(spark, d))


@query("SELECT stratum, groups, train_groups, validation_groups, calibration_groups FROM sc", views.SAMPLES, views.ONE_LABEL, _GROUPS, _COUNTS)
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_counts(splitting.groups_of(views.samples(spark, d)), RATIOS)


@query("SELECT stratum, count(*) AS groups FROM gs GROUP BY 1 HAVING count(*) < 3", views.SAMPLES, views.ONE_LABEL, _GROUPS)
def thin_strata(spark: SparkSession, d: str) -> DataFrame:
    return splitting.thin_strata(splitting.groups_of(views.samples(spark, d)))


@query("SELECT provenance_group FROM sv GROUP BY 1 HAVING min(label) <> max(label)", views.SAMPLES)
def conflicting_groups(spark: SparkSession, d: str) -> DataFrame:
    return splitting.conflicting_groups(views.samples(spark, d))


@query(
    "SELECT sample_id, CASE WHEN rank <= train_groups THEN 'train' WHEN rank <= train_groups + validation_groups THEN 'validation' ELSE 'calibration' END AS split FROM ol JOIN rk USING (provenance_group) JOIN sc USING (stratum)",
    views.SAMPLES, views.ONE_LABEL, _GROUPS, _COUNTS, f"rk AS (SELECT provenance_group, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {dialect.digest(repr(SEED), 'stratum', 'provenance_group')}, provenance_group) AS rank FROM gs)",
)
def group_splits(spark: SparkSession, d: str) -> DataFrame:
    """Strata that cannot be split are taken out first, as they are an error to the operator."""
    rows = _one_label(spark, d)
    groups = splitting.groups_of(rows)
    thin = groups.join(splitting.thin_strata(groups).select("stratum"), "stratum", "left_semi").select("provenance_group")
    return splitting.assign_groups(rows.join(thin, "provenance_group", "left_anti"), RATIOS, SEED)


@query(
    "SELECT sample_id, ol.label, provenance_group FROM ol JOIN go ON go.grp = provenance_group AND go.label = ol.label WHERE taken",
    views.SAMPLES, views.ONE_LABEL,
    f"og AS (SELECT label, provenance_group AS grp, count(*) AS n, row_number() OVER (PARTITION BY label ORDER BY {dialect.digest(repr(SEED), repr('smoke'), repr('train'), 'label', 'provenance_group')}, provenance_group) AS i FROM ol GROUP BY 1, 2)",
    "go(label, i, grp, used, taken) AS (SELECT label, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, FALSE FROM (SELECT DISTINCT label FROM og WHERE label IN (0, 1)) UNION ALL SELECT og.label, og.i, og.grp, go.used + CASE WHEN go.used + n <= 256 THEN n ELSE 0 END, go.used + n <= 256 FROM go JOIN og ON og.label = go.label AND og.i = go.i + 1)",
)
def profile_subset(spark: SparkSession, d: str) -> DataFrame:
    return selection.profile_subset(_one_label(spark, d), "smoke", "train", 256, SEED)


@query(
    "SELECT CAST(2 * o + CASE WHEN label = 1 THEN 0 ELSE 1 END AS BIGINT) AS position, sample_id, label FROM (SELECT unnest(range((SELECT max(n) FROM er))) AS o), er WHERE o % n = rank - 1",
    views.SAMPLES, f"er AS (SELECT sample_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY {dialect.digest(repr(SEED), repr('balanced'), '1', 'label', 'sample_id')}, sample_id) AS rank FROM sv)",
)
def balanced_epoch(spark: SparkSession, d: str) -> DataFrame:
    return selection.balanced_epoch(views.samples(spark, d), 1, SEED)


# Checkpoints


@query(f"SELECT checkpoint_id, {_b('epoch')}, round(validation_bce, {DIGITS}) AS validation_bce FROM cp ORDER BY cp.validation_bce, cp.epoch, global_step, checkpoint_id LIMIT 1", views.CHECKPOINTS)
def best_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    return selection.best_checkpoint(views.checkpoints(spark, d)).select("checkpoint_id", F.col("epoch").cast("bigint").alias("epoch"), _near("validation_bce"))


@query(f"SELECT {_b('a.epoch', 'epoch')}, arg_min(b.checkpoint_id, b.validation_bce) AS best_id, round(min(b.validation_bce), {DIGITS}) AS best_bce FROM cp a JOIN cp b ON b.epoch <= a.epoch GROUP BY a.epoch", views.CHECKPOINTS)
def running_best(spark: SparkSession, d: str) -> DataFrame:
    return selection.running_best(views.checkpoints(spark, d)).select(F.col("epoch").cast("bigint").alias("epoch"), "best_id", _near("best_bce"))


@query("SELECT CAST(epoch AS BIGINT) AS epoch, CASE WHEN epoch <> last + 1 THEN 'epoch' ELSE 'step' END AS problem FROM (SELECT *, coalesce(lag(epoch) OVER (ORDER BY epoch), 0) AS last, lag(global_step) OVER (ORDER BY epoch) AS before FROM cp WHERE epoch % 7 <> 0) WHERE epoch <> last + 1 OR global_step <= before", views.CHECKPOINTS)
def history_gaps(spark: SparkSession, d: str) -> DataFrame:
    """A history from which every seventh epoch was taken, as the whole one has no gaps."""
    return selection.history_gaps(views.checkpoints(spark, d).where("epoch % 7 <> 0"))


@query(f"SELECT round(v, {DIGITS}) AS ema FROM em ORDER BY step DESC LIMIT 1", views.CHECKPOINTS, "em(step, v) AS (SELECT epoch, validation_bce FROM cp WHERE epoch = 1 UNION ALL SELECT c.epoch, 9e-1 * v + (1 - 9e-1) * c.validation_bce FROM em JOIN cp c ON c.epoch = step + 1)")
def ema_fold(spark: SparkSession, d: str) -> DataFrame:
    return selection.ema(views.checkpoints(spark, d).select(F.col("epoch").alias("step"), F.col("validation_bce").alias("value")), 0.9).select(_near("ema"))


# Leakage and sets


def _values_sql(rows: str, columns: tuple[str, ...]) -> str:
    return " UNION ".join(f"SELECT {c} AS value FROM {rows} WHERE {c} IS NOT NULL" for c in columns)


def _overlap_sql(check: str) -> str:
    mine, theirs = leakage.CHECKS[check]
    return f"SELECT DISTINCT holdout_id, {theirs} AS value FROM ho WHERE {theirs} <> '' AND {theirs} IN ({_values_sql('tr', mine)})"


_LEAK = (views.SAMPLES, views.ASSIGNMENTS, views.TRAINING)


@query(_overlap_sql("id"), *_LEAK)
def leak_ids(spark: SparkSession, d: str) -> DataFrame:
    return leakage.overlap(*views.training_and_holdouts(spark, d), "id")


@query(_overlap_sql("content"), *_LEAK)
def leak_content(spark: SparkSession, d: str) -> DataFrame:
    return leakage.overlap(*views.training_and_holdouts(spark, d), "content")


@query(_overlap_sql("provenance"), *_LEAK)
def leak_provenance(spark: SparkSession, d: str) -> DataFrame:
    return leakage.overlap(*views.training_and_holdouts(spark, d), "provenance")


_FOUND = " UNION ALL ".join(f"SELECT {i} AS k, '{c}' AS check_name, * FROM ({_overlap_sql(c)})" for i, c in enumerate(leakage.CHECKS))


@query(f"SELECT check_name, value, holdout_id FROM fo JOIN (SELECT DISTINCT holdout_id, holdout_order FROM ho) USING (holdout_id) ORDER BY holdout_order, k, value LIMIT 1", *_LEAK, f"fo AS ({_FOUND})")
def leak_first(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark, "leaks")
    sides = [ws.put(df, name) for df, name in zip(views.training_and_holdouts(spark, d), ("training", "holdouts"), strict=True)]
    return leakage.first_leak(*sides).select("check_name", "value", "holdout_id")


_FIELDS = ["sample_id", "content_sha256", "provenance_group", "generator_family"]


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{f}' AS field, count(*) AS shared, array_to_string(list(v ORDER BY v)[1:3], ',') AS preview FROM (SELECT {f} AS v FROM tr WHERE {f} IS NOT NULL INTERSECT SELECT {f} FROM ho)) WHERE shared > 0" for f in _FIELDS), *_LEAK)
def eval_leakage(spark: SparkSession, d: str) -> DataFrame:
    training, holdout = views.training_and_holdouts(spark, d)
    return leakage.shared_preview(training, holdout, _FIELDS)


@query(_values_sql("tr", ("sample_id", "upstream_path")), *_LEAK)
def training_keys(spark: SparkSession, d: str) -> DataFrame:
    return leakage.values(views.training_and_holdouts(spark, d)[0], ("sample_id", "upstream_path"))


@query("SELECT 'missing' AS side, sample_id FROM (SELECT sample_id FROM sv EXCEPT SELECT sample_id FROM av WHERE manifest = 'sm-harbour') UNION ALL SELECT 'extra', sample_id FROM (SELECT sample_id FROM av WHERE manifest = 'sm-harbour' EXCEPT SELECT sample_id FROM sv)", views.SAMPLES, views.ASSIGNMENTS)
def split_set_diff(spark: SparkSession, d: str) -> DataFrame:
    return leakage.set_difference(views.samples(spark, d), views.assignments(spark, d).where("manifest = 'sm-harbour'"), "sample_id")


@query("SELECT provenance_group FROM sv JOIN av USING (sample_id) WHERE manifest = 'sm-quarry' GROUP BY 1 HAVING count(DISTINCT split) > 1", views.SAMPLES, views.ASSIGNMENTS)
def group_crossing(spark: SparkSession, d: str) -> DataFrame:
    return splitting.group_crossing(views.samples(spark, d).join(views.assignments(spark, d).where("manifest = 'sm-quarry'"), "sample_id"))


# Constraints


def _untrimmed(c: str) -> str:
    return f"coalesce({c} = '' OR {dialect.trim(c)} <> {c}, TRUE)"


def _not_a_digest(c: str) -> str:
    return f"coalesce(NOT regexp_full_match({c}, '[0-9a-f]{{64}}'), TRUE)"


def _unsafe(c: str) -> str:
    return f"coalesce(({c} = '' OR starts_with({c}, '/') OR contains({c}, chr(92)) OR list_has_any(string_split({c}, '/'), ['', '.', '..'])) AND {c} <> '.', TRUE)"


def _rules_sql(rows: str, key: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, {key} AS key FROM {rows} WHERE {broken}" for rule, broken in rules.items())


def _duplicates_sql(rows: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT 'duplicate {c}' AS rule, {c} AS key FROM {rows} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1" for c in columns)


_SAMPLE_RULES = {
    **{c: _untrimmed(c) for c in ("sample_id", "source_id", "provenance_group", "content_type")},
    **{c: _unsafe(c) for c in ("upstream_path", "local_path")},
    "label": "coalesce(label NOT IN (0, 1), TRUE)",
    "content_sha256": _not_a_digest("content_sha256"),
    "upstream_sha256": f"upstream_sha256 IS NOT NULL AND {_not_a_digest('upstream_sha256')}",
    "generator_family": f"label = 1 AND {_untrimmed('generator_family')}",
}


@query(_rules_sql("samples", "sample_id", _SAMPLE_RULES))
def sample_violations(spark: SparkSession, d: str) -> DataFrame:
    return validate.broken_rules(table(spark, d, "samples"), F.col("sample_id"), validate.sample_rules())


_RAW = ("__key__", "hash_sha256", "hash_perceptual", "sscd_cluster_id", "source", "license", "thumbnail")
_PARSE_RULES = {
    **{f"{c} missing": f"{c} IS NULL" for c in _RAW},
    "thumbnail empty": "octet_length(thumbnail) = 0",
    "hash_sha256 malformed": f"hash_sha256 IS NOT NULL AND {_not_a_digest('hash_sha256')}",
    "source not approved": f"source NOT IN {tuple(views.CONTRACTS)}",
}


@query(_rules_sql("monet_rows", "__key__", _PARSE_RULES))
def parse_violations(spark: SparkSession, d: str) -> DataFrame:
    return validate.broken_rules(table(spark, d, "monet_rows"), F.col("__key__"), parse_rules(approved=tuple(views.CONTRACTS)))


@query(_duplicates_sql("sv", ["sample_id", "local_path", "content_sha256"]), views.SAMPLES)
def manifest_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(views.samples(spark, d), ["sample_id", "local_path", "content_sha256"])


@query(_duplicates_sql("mo", ["key", "hash_sha256"]), views.MONET)
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(views.monet(spark, d), ["key", "hash_sha256"])


@query(f"SELECT DISTINCT {dialect.cat('source_id')} AS source_id FROM samples WHERE {dialect.cat('source_id')} NOT IN (SELECT 'monet-' || source FROM ct)", views.CONTRACTS_SQL)
def unknown_source(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "samples", "source_id").select(category("source_id").alias("source_id"))
    return validate.unknown_keys(named, "source_id", views.contracts(spark).select(F.concat(F.lit("monet-"), "source").alias("source_id")))


@query("SELECT key, license FROM mo JOIN ct USING (source) WHERE coalesce(mo.license <> expected_license, TRUE)", views.MONET, views.CONTRACTS_SQL)
def license_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = views.monet(spark, d).join(F.broadcast(views.contracts(spark)), "source")
    return rows.where("coalesce(license <> expected_license, true)").select("key", "license")


@query(f"SELECT {_b('sum(CASE WHEN label = 0 THEN 1 ELSE 0 END)', 'real')}, {_b('sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)', 'ai')}, count(DISTINCT CASE WHEN label IN (0, 1) THEN label END) = 2 AS both FROM samples")
def class_presence(spark: SparkSession, d: str) -> DataFrame:
    return validate.class_presence(table(spark, d, "samples", "label"))


@query('SELECT "__key__" AS key FROM monet_rows WHERE coalesce(isnan(aesthetic_score) OR aesthetic_score NOT BETWEEN 0 AND 1, TRUE)')
def bad_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Scores of monet rows that are no probabilities."""
    return table(spark, d, "monet_rows", "__key__", "aesthetic_score").where(bad_probability(F.col("aesthetic_score"))).select(F.col("__key__").alias("key"))


_RESULTS = """re AS (SELECT "__key__" AS id, CASE WHEN license IS NULL THEN 'error' ELSE 'ok' END AS status, aesthetic_score AS confidence, CASE WHEN license IS NULL THEN source END AS code FROM monet_rows WHERE "__key__" IS NOT NULL)"""


@query(
    f"""SELECT 'duplicate id' AS rule, id AS key FROM re GROUP BY id HAVING count(*) > 1
 UNION ALL SELECT 'unknown id', id FROM (SELECT id FROM re EXCEPT SELECT key FROM mo) UNION ALL SELECT 'missing id', key FROM (SELECT key FROM mo EXCEPT SELECT id FROM re)
 UNION ALL SELECT 'ok', id FROM re WHERE status = 'ok' AND coalesce(isnan(confidence) OR confidence NOT BETWEEN 0 AND 1, TRUE)
 UNION ALL SELECT 'error', id FROM re WHERE status = 'error' AND (confidence IS NOT NULL OR coalesce(trim(code) = '', TRUE))""",
    views.MONET, _RESULTS,
)
def result_violations(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries as results of the approved keys: the score is the confidence, a row without licence an error."""
    rows = table(spark, d, "monet_rows", "__key__", "license", "source", "aesthetic_score").where("`__key__` is not null")
    failed = F.col("license").isNull()
    code = F.when(failed, F.col("source"))
    results = rows.select(F.col("__key__").alias("id"), F.when(failed, "error").otherwise("ok").alias("status"), F.col("aesthetic_score").alias("confidence"), code.alias("code"), code.alias("message"))
    return validate.result_violations(views.monet(spark, d).select(F.col("key").alias("id")), results)


# Images of pages

_PLAN = """pp AS (SELECT page_id, source, min(pos) AS first_pos, arg_min(alt, (pos, alt)) AS alt, count(*) AS elements FROM pe WHERE source IS NOT NULL GROUP BY 1, 2),
 pl AS (SELECT page_id, 'image-' || row_number() OVER (PARTITION BY page_id ORDER BY first_pos, source) AS id, source, alt, first_pos, elements FROM pp)"""


@query("SELECT page_id, id, source, alt, first_pos, elements FROM pl", views.PAGE_IMAGES, _PLAN)
def image_plan(spark: SparkSession, d: str) -> DataFrame:
    return pages.image_plan(views.page_images(spark, d))


@query("SELECT pe.page_id, CAST(sum(CASE WHEN pe.source IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS count, CAST(sum(CASE WHEN length(pe.source) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(CASE WHEN pe.source IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM pe GROUP BY 1", views.PAGE_IMAGES)
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose length three divides stand for those that failed."""
    images = views.page_images(spark, d)
    plan = Workspace(spark, "summary").put(pages.image_plan(images), "plan")  # read twice
    return pages.scan_summary(images, plan, plan.select("page_id", "id", F.when(F.length("source") % 3 == 0, "error").otherwise("ok").alias("status")))


@query(f"SELECT page_id, source, CASE WHEN starts_with(source, '{PAGE}') THEN 'allow' ELSE 'IMAGE_ORIGIN_NOT_ALLOWED' END AS gate FROM pl", views.PAGE_IMAGES, _PLAN)
def origin_gate(spark: SparkSession, d: str) -> DataFrame:
    return pages.image_plan(views.page_images(spark, d)).select("page_id", "source", origin_gate_of(F.col("source"), F.lit(PAGE)).alias("gate"))


@query(f"SELECT vec_id, 'ok' AS status, round(1 / (1 + exp(-list_sum(CAST(embedding AS DOUBLE[])) / 8)), {DIGITS}) AS confidence FROM embeddings")
def score_batches(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings", "vec_id", "embedding")
    width = len((vectors.first() or {"embedding": []})["embedding"])
    return pages.score(vectors, ["vec_id"], pages.linear_scorer([0.125] * width)).select("vec_id", "status", _near("confidence"))


# The decimal form is rounded half up, as the printed number is.
@query(f"SELECT vec_id, format('{{:.1f}}%', CAST(round(CAST(100 * round(1 / (1 + exp(-list_sum(CAST(embedding AS DOUBLE[])) / 8)), {DIGITS}) AS DECIMAL(18, 8)), 1) AS DOUBLE)) AS label FROM embeddings")
def result_labels(spark: SparkSession, d: str) -> DataFrame:
    """F17 over the scores of ``score_batches``."""
    return score_batches(spark, d).select("vec_id", result_label_of(F.col("status"), F.col("confidence"), F.lit(None).cast("string")).alias("label"))


from plumbline.plans import catalog_records  # noqa: E402, F401  (registers its queries here)
