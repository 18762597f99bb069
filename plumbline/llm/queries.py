"""The queries of the nine problems over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.compare import bits64, category, digest, key_text
from plumbline.llm import chunkstore, group_splits, mixing, nested_sample, packing, quota_sample, split_overlap, subjects, top_items
from plumbline.llm.picture_names import picture_name_udf
from plumbline.llm.tokens import token_count
from plumbline.llm.words import word_count
from plumbline.session import Workspace
from plumbline.sources.tables import table

SEED = "plumbline-1"


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """(kind, key, content, batch): each delivered content of the three kinds of records."""
    samples = table(spark, d, "samples", "sample_id", "content_sha256", "upstream_sha256", "batch_id")
    contents = F.explode(F.array(digest("content_sha256"), digest("upstream_sha256")))
    rows = samples.select(F.lit("sample").alias("kind"), key_text("sample_id").alias("key"), contents.alias("content"), F.col("batch_id").alias("batch"))
    monet = table(spark, d, "monet_rows", "__key__", "hash_sha256", "batch_id")
    rows = rows.unionByName(monet.select(F.lit("monet").alias("kind"), F.col("__key__").alias("key"), digest("hash_sha256").alias("content"), F.col("batch_id").alias("batch")))
    mirage = table(spark, d, "mirage_rows", "file_name", "batch_id").where("file_name is not null").distinct()
    return rows.unionByName(mirage.select(F.lit("mirage").alias("kind"), F.col("file_name").alias("key"), picture_name_udf("file_name").alias("content"), F.col("batch_id").alias("batch")))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """(kind, key, bits, batch): the perceptual hashes."""
    monet = table(spark, d, "monet_rows", "__key__", "hash_perceptual", "batch_id")
    return monet.select(F.lit("monet").alias("kind"), F.col("__key__").alias("key"), bits64("hash_perceptual").alias("bits"), F.col("batch_id").alias("batch"))


#: The session setting that names a lasting folder for the chunk table of problem 1.
STORE = "spark.plumbline.store"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """New records and the earlier ones that they repeat, by the chunk table.

    Accepted batches enter the table once; the new ones are then cut, matched and
    appended. Where the session names a lasting folder (STORE), batches that it holds
    already are not read again; otherwise the table starts empty.
    """
    ws = Workspace(spark, "p1")
    lasting = spark.conf.get(STORE, None)
    chunks = chunkstore.ChunkTable(spark, lasting or ws.path("store"), ws)
    states = table(spark, d, "batches", "batch_id", "state").where("batch_id is not null")
    new = [r[0] for r in states.where(key_text("state") == "new").select("batch_id").distinct().collect()]  # a row per batch
    held = [b for b in chunks.batches() if b not in new] if lasting else []
    deliveries, marks, batch = _deliveries(spark, d), _marks(spark, d), F.col("batch")
    chunks.append(deliveries.where(~batch.isin(new + held)), marks.where(~batch.isin(new + held)))
    chunks.forget_deliveries()
    found = chunks.ingest(deliveries.where(batch.isin(new)), marks.where(batch.isin(new)), coverage=1.0, exact=True)
    low, high = F.least("key_new", "key_old"), F.greatest("key_new", "key_old")
    return found.select(F.col("kind").alias("record_kind"), low.alias("key_a"), high.alias("key_b"))


def _records(spark: SparkSession, d: str, upto: int | None = None) -> DataFrame:
    """(record_kind, record_key) of what arrived up to a batch, by lowest batch of each key."""
    samples = table(spark, d, "samples", "sample_id", "provenance_group", "batch_id")
    monet = table(spark, d, "monet_rows", "__key__", "batch_id")
    rows = samples.select(F.lit("sample").alias("record_kind"), key_text("sample_id").alias("record_key"), "batch_id")
    rows = rows.unionByName(samples.select(F.lit("group").alias("record_kind"), key_text("provenance_group").alias("record_key"), "batch_id"))
    rows = rows.unionByName(monet.select(F.lit("monet").alias("record_kind"), key_text("__key__").alias("record_key"), "batch_id"))
    return (rows if upto is None else rows.where(F.col("batch_id") <= upto)).select("record_kind", "record_key")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that an earlier or parallel run of a draw chose and a later one lacks."""
    draws = table(spark, d, "draws")
    return nested_sample.unstable_records(draws.select("draw_id", "run_no", key_text("record_kind").alias("record_kind"), key_text("record_key").alias("record_key")), SEED)


#: Three draws of the growing sample: the last batch that had arrived, and the share wanted.
DRAWS = ((4, 0.03), (7, 0.04), (10, 0.05))


def p2_growth(spark: SparkSession, d: str) -> DataFrame:
    """Three draws from one stored bucket list while batches arrive: what was listed, chosen and lost since the draw before."""
    ws = Workspace(spark, "p2")
    buckets = nested_sample.BucketList(spark, ws.path("buckets"))
    out = before = None
    for draw, (last, share) in enumerate(DRAWS, 1):
        upto = buckets.extend(nested_sample.listed(share))
        chosen = ws.put(nested_sample.nested_sample(_records(spark, d, last), upto, SEED), f"draw-{draw}")
        lost = F.lit(0).cast("bigint")
        one = chosen.agg(F.lit(draw).alias("draw"), F.lit(upto).alias("listed"), F.count("*").alias("records"))
        if before is not None:
            one = one.crossJoin(before.join(chosen, ["record_kind", "record_key"], "left_anti").agg(F.count("*").alias("lost")))  # one row each
        else:
            one = one.withColumn("lost", lost)
        out, before = one if out is None else out.unionByName(one), chosen
    return out


def p2_nested_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 5 % of all samples, groups and monet rows that only grows with new batches."""
    return nested_sample.nested_sample(_records(spark, d), nested_sample.listed(0.05), SEED)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The 3 highest-scoring monet rows of each source and cluster with more than 3."""
    rows = table(spark, d, "monet_rows", "__key__", "source", "sscd_cluster_id", "aesthetic_score")
    items = rows.select(category("source").alias("source"), "sscd_cluster_id", F.col("__key__").alias("key"), F.col("aesthetic_score").alias("score"))
    best = top_items.top_items(items, ["source", "sscd_cluster_id"], 3, Workspace(spark, "p3"), more_than=3)
    return best.select("source", "sscd_cluster_id", F.col("key").alias("monet_key"))


def _categories(df: DataFrame, *first: str) -> DataFrame:
    return df.select(*first, category("source_id").alias("source_id"), category("generator_family").alias("generator_family"), category("content_type").alias("content_type"), "label")


def _p4(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    samples = table(spark, d, "samples", "sample_id", "source_id", "generator_family", "content_type", "label")
    records = _categories(samples.withColumn("key", key_text("sample_id")), "key")
    targets = _categories(table(spark, d, "sample_targets"), "target_id", "target_set", "target_share", "min_records", "sample_size")
    return records, targets


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Targets that the allocation could not meet from their own category."""
    return quota_sample.shortfalls(p4_report(spark, d)).select("target_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per target: wanted, available and allotted records, what is unmet and what was passed on."""
    return quota_sample.allocation(quota_sample.supply(*_p4(spark, d)))


def p4_unmet(spark: SparkSession, d: str) -> DataFrame:
    """Per target what SQL can say, too: wanted and available records and what its own category lacks, and that no quota exceeds it."""
    return p4_report(spark, d).select("target_id", "target_set", F.round("wanted", 6).alias("wanted"), "min_records", "available", F.round("unmet", 6).alias("unmet"), (F.col("quota") <= F.col("available")).alias("within"))


def p4_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Per target set: its size, what its categories hold together, and what was drawn."""
    records, targets = _p4(spark, d)
    ws = Workspace(spark, "p4")
    quotas = ws.put(quota_sample.allocation(quota_sample.supply(records, targets)), "quotas")
    drawn = quota_sample.draw(records, targets, quotas, SEED, ws).groupBy("target_set").agg(F.count("*").alias("drawn"), F.countDistinct("key").alias("distinct_keys"))
    sets = quotas.groupBy("target_set").agg(F.max("sample_size").alias("sample_size"), F.sum("available").alias("available"), F.sum("quota").alias("quota"))
    return sets.join(drawn, "target_set", "left").select("target_set", "sample_size", "available", "quota", "drawn", "distinct_keys")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn records."""
    records, targets = _p4(spark, d)
    ws = Workspace(spark, "p4")
    quotas = ws.put(quota_sample.allocation(quota_sample.supply(records, targets)), "quotas")
    return quota_sample.draw(records, targets, quotas, SEED, ws).withColumnRenamed("key", "sample_id")


def _membership(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "samples", "sample_id", "provenance_group")
    return rows.select(key_text("sample_id").alias("key"), key_text("provenance_group").alias("grp")).where("key is not null").distinct()


def _assignments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "split_assignments")
    named = rows.select(F.col("split_manifest_id").alias("manifest"), key_text("sample_id").alias("key"), category("split").alias("split"))
    return named.where("manifest is not null and key is not null and split is not null").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Provenance groups that a stored manifest tears apart."""
    ws = Workspace(spark, "p5")
    membership = ws.put(_membership(spark, d).where("grp is not null"), "membership")
    torn = group_splits.torn_groups(_assignments(spark, d), membership, group_splits.group_components(membership, ws))
    return torn.select(F.col("manifest").alias("split_manifest_id"), F.col("grp").alias("provenance_group"))


def p5_assignments(spark: SparkSession, d: str) -> DataFrame:
    """(split_manifest_id, sample_id, split): a fresh assignment under each manifest's ratios."""
    ws = Workspace(spark, "p5")
    members = ws.put(_membership(spark, d), "members")
    grouped = members.where("grp is not null")
    of_group = ws.put(group_splits.group_components(grouped, ws), "of-group")
    known = grouped.join(of_group, "grp").groupBy("key").agg(F.min("component").alias("component"))
    alone = members.select("key").distinct().join(known.select("key"), "key", "left_anti").select("key", F.concat(F.lit("alone\x1f"), "key").alias("component"))
    component = ws.put(known.unionByName(alone), "component-of")
    sizes = component.groupBy("component").agg(F.count("*").alias("n"))
    out = None
    for m in table(spark, d, "split_manifests", "split_manifest_id", "seed", "ratios").orderBy("split_manifest_id").collect():
        split = group_splits.assign_splits(sizes, m["ratios"], m["seed"])
        rows = component.join(split.select("component", "split"), "component").select(F.lit(m["split_manifest_id"]).alias("split_manifest_id"), F.col("key").alias("sample_id"), "split")
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_balance(spark: SparkSession, d: str) -> DataFrame:
    """How near the fresh assignments come to the ratios."""
    counts = p5_assignments(spark, d).groupBy("split_manifest_id", "split").agg(F.count("*").alias("n"))
    total = counts.groupBy("split_manifest_id").agg(F.sum("n").alias("total"))
    wanted = table(spark, d, "split_manifests", "split_manifest_id", "ratios").select("split_manifest_id", F.explode("ratios").alias("split", "ratio"))
    return counts.join(total, "split_manifest_id").join(wanted, ["split_manifest_id", "split"], "right").select("split_manifest_id", "split", "ratio", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def _overlap_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assigned records, the values that they are compared by, and (manifest, e_id, split, source) of evaluation records."""
    ws = Workspace(spark, "p6")
    samples = table(spark, d, "samples", "sample_id", "source_id", "content_sha256").select(key_text("sample_id").alias("sample_id"), category("source_id").alias("source"), digest("content_sha256").alias("digest")).where("sample_id is not null")
    known = samples.select("sample_id").distinct()
    rows = _assignments(spark, d).where(F.col("split").isin("train", "validation", "calibration")).select("manifest", F.col("key").alias("sample_id"), "split")
    kept = ws.put(rows.join(known, "sample_id"), "assigned")
    assigned = kept.select("manifest", "sample_id", (F.col("split") == "train").alias("in_train")).distinct()
    monet = table(spark, d, "monet_rows", "__key__", "hash_perceptual", "sscd_cluster_id").where("`__key__` is not null")
    as_sample = key_text(F.concat(F.lit("monet:"), "__key__")).alias("sample_id")
    value = lambda how, text: F.struct(F.lit(how).alias("how"), text.alias("text"))
    of_monet = F.explode(F.array(value("perceptual", split_overlap.hash_text(bits64("hash_perceptual"))), value("cluster", F.col("sscd_cluster_id")))).alias("v")
    values = monet.select(as_sample, of_monet).select("sample_id", "v.*").unionByName(samples.select("sample_id", F.lit("content").alias("how"), F.col("digest").alias("text")))
    source = samples.groupBy("sample_id").agg(F.min("source").alias("source"))
    named = kept.where("split <> 'train'").join(source, "sample_id").withColumnRenamed("sample_id", "e_id")
    return assigned, ws.put(values.where("text is not null").distinct(), "values"), named


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and an evaluation sample that are the same or nearly so."""
    assigned, values, _ = _overlap_inputs(spark, d)
    found = split_overlap.overlaps(assigned, values)
    return found.select(F.col("manifest").alias("split_manifest_id"), F.least("e_id", "t_id").alias("sample_a"), F.greatest("e_id", "t_id").alias("sample_b")).distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per manifest, split, source and kind of overlap: evaluation samples that overlap, and their links to training samples.

    A link is one training sample that shares one value; no pair is made to count them.
    """
    assigned, values, named = _overlap_inputs(spark, d)
    linked = split_overlap.links(assigned, values).join(named, ["manifest", "e_id"])
    return linked.groupBy(F.col("manifest").alias("split_manifest_id"), "split", "source", "how").agg(F.count("*").alias("samples"), F.sum("links").alias("links"))


def _packed(spark: SparkSession, d: str, size) -> DataFrame:
    items = Workspace(spark, "p7").put(packing.sized(table(spark, d, "documents", "doc_id", "text"), size), "sizes")
    classes = table(spark, d, "containers").select("container_class", F.col("capacity_words").alias("capacity"))
    return packing.packing(items, classes, SEED)


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """Where each document, or piece of a too long one, lies; sizes in words."""
    return _packed(spark, d, word_count)


def p7_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The same with sizes in tokens of a public tokenizer, the capacities being taken as tokens."""
    return _packed(spark, d, token_count())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the packing had to cut, as they alone exceed the container."""
    return packing.oversized(p7_packing(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per class: containers, pieces, words and the share of the space that is filled."""
    return packing.fill(p7_packing(spark, d), table(spark, d, "containers").withColumnRenamed("capacity_words", "capacity"))


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per class what SQL can say, too: documents, pieces and words placed, containers above the capacity, documents cut without need."""
    placed = Workspace(spark, "p7").put(p7_packing(spark, d), "placed")
    classes = table(spark, d, "containers").withColumnRenamed("capacity_words", "capacity")
    whole = placed.groupBy("container_class", "doc_id").agg(F.sum("size").alias("words"), F.count("*").alias("pieces")).join(classes, "container_class")
    needless = F.sum(((F.col("pieces") > 1) & (F.col("words") <= F.col("capacity"))).cast("bigint"))
    per = whole.groupBy("container_class").agg(F.count("*").alias("documents"), F.sum("pieces").alias("pieces"), F.sum("words").alias("words"), needless.alias("needless"))
    over = placed.groupBy("container_class", "container").agg(F.sum("size").alias("words")).join(classes, "container_class").groupBy("container_class").agg(F.sum((F.col("words") > F.col("capacity")).cast("bigint")).alias("overfull"))
    return per.join(over, "container_class")


def _mixture(spark: SparkSession, d: str, size=word_count) -> tuple[DataFrame, DataFrame]:
    ws = Workspace(spark, "p8")
    documents = table(spark, d, "documents", "doc_id", "source", "text")
    sizes = documents.select("doc_id", category("source").alias("source"), size("text").alias("size")).where("doc_id is not null and source is not null and size > 0")
    items = ws.put(sizes.groupBy("doc_id").agg(F.max_by(F.struct("source", "size"), F.struct("size", "source")).alias("x")).select("doc_id", "x.*"), "sizes")
    targets = table(spark, d, "mix_targets").join(table(spark, d, "mixtures").withColumnRenamed("budget_words", "budget"), "mixture_id").withColumn("source", category("source"))
    return items, ws.put(mixing.plan(items, targets, SEED), "plan")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per mixture and source: wanted and reached sizes and shares."""
    items, planned = _mixture(spark, d)
    return mixing.shares(planned, mixing.replicate(items, planned, SEED))


def p8_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The same with sizes in tokens of a public tokenizer, the budgets being taken as tokens."""
    items, planned = _mixture(spark, d, token_count())
    return mixing.shares(planned, mixing.replicate(items, planned, SEED))


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per target what SQL can say, too: whether the cap is kept, and whether the size is right to two documents."""
    goal = F.least(F.col("wanted"), F.col("max_repeats") * F.col("available").cast("double"))
    near = F.abs(F.col("taken") - goal) <= 2 * F.col("largest")
    return p8_shares(spark, d).select("mixture_id", "source", "available", F.round("wanted", 6).alias("wanted"), "short", (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"), (near | (goal == 0)).alias("size_right"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot give what the mixture wants: short by plan, and drawn to the last copy of every document."""
    return p8_shares(spark, d).where("short and taken = max_repeats * available").select("mixture_id", "source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixtures themselves, one row per copy, globally shuffled."""
    items, planned = _mixture(spark, d)
    return mixing.shuffled(mixing.replicate(items, planned, SEED), SEED)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of each document's own dispute."""
    known = table(spark, d, "subjects").select(category("subject").alias("subject")).distinct()
    labels = table(spark, d, "subject_labels").select("doc_id", category("subject").alias("subject")).distinct().join(known, "subject")
    return subjects.propagate(table(spark, d, "documents", "doc_id", "text"), labels, Workspace(spark, "p9")).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject and language, as delivered; documents with several subjects count in each."""
    lang = table(spark, d, "documents", "doc_id", "lang").select("doc_id", key_text("lang").alias("lang"))
    return p9_found(spark, d).join(lang, "doc_id").groupBy("subject", "lang").agg(F.count("*").alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_nested_sample, p2_growth, p3_found, p4_found, p4_report, p4_unmet, p4_sample, p4_drawn, p5_found, p5_assignments, p5_balance, p6_found, p6_counts, p7_found, p7_packing, p7_fill, p7_audit, p7_tokens, p8_found, p8_shares, p8_tokens, p8_audit, p8_mixture, p9_found, p9_composition)
}
