"""Problem 2: a reproducible sample that stays as data grows.

Every key belongs for ever to one of BUCKETS fine hash buckets. A fixed permutation
orders the buckets, and a sample is a prefix of that order: a list of buckets to which
later draws may only append (``BucketList`` stores it). A record is chosen exactly if
its bucket is listed, so neither reruns, row order, repeats and spellings nor new records
can remove one that was chosen before, and larger samples contain smaller ones.

Samples that were drawn in other ways are audited along the same buckets: what a run
chose is summed up per bucket, buckets on which all runs agree are settled without
looking at a record, and the records of the others are compared one by one.

Nulls: records with a null or blank key are never chosen. Repeated rows are one record.
An empty table gives an empty sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.hashing import hash_number

#: A prime, so that multiplication by STRIDE permutes the buckets (fixed values).
BUCKETS, STRIDE, OFFSET = 65_521, 40_503, 12_345


def bucket(key: Column, kind: Column, seed: str) -> Column:
    return F.pmod(hash_number(seed, kind, key), F.lit(BUCKETS)).cast("bigint")


def place(bucket_id: Column) -> Column:
    """The bucket's place in the fixed order, from 0."""
    return F.pmod(bucket_id * STRIDE + OFFSET, F.lit(BUCKETS)).cast("bigint")


def bucket_at(place_no: Column) -> Column:
    """The bucket at a place of the fixed order."""
    return F.pmod((place_no - OFFSET) * pow(STRIDE, -1, BUCKETS), F.lit(BUCKETS)).cast("bigint")


def listed(share: float, before: int = 0) -> int:
    """How many buckets a draw of ``share`` lists, never fewer than an earlier draw listed."""
    if not 0 <= share <= 1:
        raise ValueError("share must lie in [0, 1]")
    return max(before, round(share * BUCKETS))


class BucketList:
    """The stored list of buckets, a Parquet folder of (place, bucket) to which rows are only ever added."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def rows(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], "place bigint, bucket bigint")
        return self.spark.read.schema("place bigint, bucket bigint").parquet(self.path).distinct()

    def upto(self) -> int:
        """How many buckets are listed."""
        return self.rows().agg(F.coalesce(F.max("place") + 1, F.lit(0))).first()[0]

    def extend(self, upto: int) -> int:
        """Lists the buckets of the places below ``upto`` that are not listed yet; never takes one off."""
        before = self.upto()
        upto = min(upto, BUCKETS)
        if upto > before:
            places = self.spark.range(before, upto, numPartitions=1).select(F.col("id").alias("place"))
            places.withColumn("bucket", bucket_at(F.col("place"))).write.mode("append").parquet(self.path)
        return max(before, upto)


def nested_sample(records: DataFrame, buckets: int, seed: str) -> DataFrame:
    """(record_kind, record_key, bucket_place) of the records in the first ``buckets`` listed buckets.

    ``records`` has record_kind and the normalised record_key; the filter is a pure
    expression of each row, so it runs inside the scan, before the distinct.
    """
    at = place(bucket(F.col("record_key"), F.col("record_kind"), seed))
    return records.where(F.col("record_key").isNotNull() & F.col("record_kind").isNotNull()).select("record_kind", "record_key", at.alias("bucket_place")).where(F.col("bucket_place") < buckets).distinct()


def size_for(records: DataFrame, wanted: int, seed: str, before: int = 0) -> int:
    """The smallest prefix of the bucket list that holds ``wanted`` records, at least ``before``.

    Collects one count per bucket, at most BUCKETS rows.
    """
    at = place(bucket(F.col("record_key"), F.col("record_kind"), seed)).alias("at")
    counts = dict(records.where("record_key is not null and record_kind is not null").select("record_kind", "record_key").distinct().groupBy(at).count().collect())
    total, n = 0, 0
    while total < wanted and n < BUCKETS:
        total += counts.get(n, 0)
        n += 1
    return max(before, n)


def unstable_records(draws: DataFrame, seed: str) -> DataFrame:
    """(record_kind, record_key) that a run chose and a run of the same or a higher draw lacks.

    Each run's choice is summed up per bucket: a count and two order-free 64-bit prints.
    A bucket is settled if every run from its first draw up has the same sums, as reruns
    of one list must; the records of the other buckets are compared exactly: with ``low``
    the lowest draw that chose a record, it is stable if all runs of draws from ``low`` up
    have it. Only counts move, two-phase, whatever share of the rows a kind or bucket holds.
    ``draws``: draw_id, run_no, record_kind, record_key (normalised).
    """
    known = draws.where("draw_id is not null and run_no is not null")
    per_draw = known.select("draw_id", "run_no").distinct().groupBy(F.col("draw_id").alias("low")).agg(F.count("*").alias("runs"))
    # One row per draw: the runs of this and all higher draws.
    due = per_draw.select("low", F.sum("runs").over(Window.orderBy(F.col("low").desc())).alias("due"))
    rows = known.where("record_kind is not null and record_key is not null").select("record_kind", "record_key", bucket(F.col("record_key"), F.col("record_kind"), seed).alias("bucket"), "draw_id", "run_no").distinct()
    sums = F.struct(F.count("*"), F.bit_xor(F.xxhash64("record_key")), F.bit_xor(F.xxhash64(F.lit(1), "record_key")))
    runs = rows.groupBy("record_kind", "bucket", "draw_id", "run_no").agg(sums.alias("sums"))
    agreed = runs.groupBy("record_kind", "bucket").agg(F.min("draw_id").alias("low"), F.count("*").alias("seen"), F.min("sums").alias("least"), F.max("sums").alias("most"))
    open_ = agreed.join(due, "low").where("seen < due or least <> most").select("record_kind", "bucket")
    seen = rows.join(open_, ["record_kind", "bucket"], "left_semi").groupBy("record_kind", "record_key").agg(F.min("draw_id").alias("low"), F.count("*").alias("seen"))
    return seen.join(due, "low").where("seen < due").select("record_kind", "record_key")
