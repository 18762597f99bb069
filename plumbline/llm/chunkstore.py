"""Problem 1: deduplicating new batches against all history.

A record is a set of contents (byte strings). A rolling hash cuts each content into
chunks at boundaries that the content itself defines. ``ChunkTable`` is a folder of
Parquet tables that outlives the session: which record has which content, and which
content has which chunks, one partition per batch. A new batch is cut and joined with
the stored chunks on the chunk hash alone; the bytes that a new and a stored content
share are summed up, and the pair is kept if they cover enough of the larger of the two.
History is never cut again, only joined with. Then the batch is taken in: every record is
entered with its contents, and the chunks of those contents are appended that the table
did not have. Appending a batch again replaces its own partition by the same rows.

A content is known by 128 bits of its SHA-256 and stands in the chunk table once,
however many records have it; so the chunk join works on distinct contents and copies
come in only when pairs of records are wanted.

Contents with chunks that very many contents share are looked up by their rarest chunks:
a pair that covers the share ``c`` must meet in any selection of the new content's
chunks that holds more than ``1 - c`` of its bytes, so probing with the rarest such
selection loses nothing and no bucket is capped.

64-bit perceptual hashes are too short for content-defined boundaries (three flipped
bits can destroy every chunk), so their chunks are cut at fixed places: see
``bitblocks``. Their block keys are stored in the same way, once per distinct number; the
pairs follow from agreeing blocks, and the differing bits are then counted exactly.

Nulls: a null key or batch is skipped; a null or empty content has no chunks and repeats
nothing, though its record is entered with its batch. Repeated rows count once; of a
key's batches the lowest counts. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bitblocks import agreeing, block_keys
from plumbline.llm.hashing import by_value
from plumbline.session import Workspace

WINDOW, SMALLEST, AVERAGE, LARGEST = 16, 16, 32, 128
#: How many bits near perceptual hashes differ in at most.
BITS_APART = 3
#: The tables of a folder; ``batch`` is their partition, ``first`` the batch in which a record came first, ``no`` a chunk's number in its content.
TABLES = {
    "members": "kind string, key string, content_id binary, first bigint",
    "chunks": "kind string, content_id binary, bytes bigint, no int, chunk bigint, chunk_bytes int",
    "marks": "kind string, key string, bits bigint, first bigint",
    "blocks": "kind string, bits bigint, block_key bigint",
}


def _gear() -> np.ndarray:
    """256 random 64-bit numbers by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the hash of the last WINDOW bytes: every byte's number, shifted by its age, summed up."""
    h = _gear()[data]
    step = 1
    while step < WINDOW:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint64(step)
        h = h + older
        step *= 2
    return h


def cut_points(lengths: np.ndarray, data: np.ndarray) -> list[list[int]]:
    """For each of the contents that ``data`` holds end to end, the ends of its chunks."""
    mask = np.uint64(AVERAGE - 1) << np.uint64(40)
    marks = np.flatnonzero((rolling_hash(data) & mask) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    bounds = np.searchsorted(marks, starts)
    out = []
    for i, length in enumerate(lengths.tolist()):
        ends, last = [], 0
        for mark in (marks[bounds[i] : bounds[i + 1]] - starts[i]).tolist():
            if mark < WINDOW or mark >= length:  # the window would reach into the content before
                continue
            while mark - last > LARGEST:
                last += LARGEST
                ends.append(last)
            if mark - last >= SMALLEST:
                ends.append(last := mark)
        while length - last > LARGEST:
            last += LARGEST
            ends.append(last)
        if length > last:
            ends.append(length)
        out.append(ends)
    return out


def chunks_of(content: bytes) -> list[tuple[int, int]]:
    """(hash, bytes) of each chunk; the n-th occurrence of the same bytes has a hash of its own."""
    ends = cut_points(np.array([len(content)]), np.frombuffer(content, np.uint8))[0]
    return _hashed(content, ends)


def _hashed(content: bytes, ends: list[int]) -> list[tuple[int, int]]:
    seen: dict[bytes, int] = {}
    out, last = [], 0
    for end in ends:
        piece = content[last:end]
        n = seen[piece] = seen.get(piece, -1) + 1
        out.append((xxhash.xxh3_64_intdigest(piece, n) - (1 << 63), end - last))
        last = end
    return out


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = [c.encode("utf-8", "surrogatepass") for c in batch.column("content").to_pylist()]
        lengths = np.fromiter((len(c) for c in contents), np.int64, len(contents))
        whole = np.frombuffer(b"".join(contents), np.uint8)
        rows, number, chunk, size = [], [], [], []
        for i, ends in enumerate(cut_points(lengths, whole)):
            for no, (h, n) in enumerate(_hashed(contents[i], ends)):
                rows.append(i)
                number.append(no)
                chunk.append(h)
                size.append(n)
        take = pa.array(rows, pa.int64())
        names = [n for n in batch.schema.names if n != "content"]
        made = [pa.array(lengths).take(take), pa.array(number, pa.int32()), pa.array(chunk, pa.int64()), pa.array(size, pa.int32())]
        yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in names), *made], names=[*names, "bytes", "no", "chunk", "chunk_bytes"])


def content_id(content: Column) -> Column:
    """16 bytes that stand for a content."""
    return F.unhex(F.substring(F.sha2(content, 256), 1, 32))


def cut(contents: DataFrame) -> DataFrame:
    """The chunk rows of (kind, content_id, content, batch)."""
    return contents.select("kind", "content_id", "batch", "content").mapInArrow(_cut_batches, "kind string, content_id binary, batch bigint, bytes bigint, no int, chunk bigint, chunk_bytes int")


def by_batch(df: DataFrame) -> DataFrame:
    """The same rows, those of a batch together: a task then writes a file or two instead of one for each batch.

    On a local disk each new file starts processes of its own to set its rights. Batches
    larger than the advisory size are split, small ones share a task.
    """
    return df.hint("rebalance", "batch")


class ChunkTable:
    """The persistent tables below ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, workspace: Workspace):
        self.spark, self.root, self.workspace = spark, root.rstrip("/"), workspace
        self._runs = 0

    def rows(self, name: str) -> DataFrame:
        """One of TABLES, as stored so far."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        schema = f"{TABLES[name]}, batch bigint"
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def batches(self) -> list[int]:
        """The batches that are stored, from the names of their partitions."""
        return sorted(r[0] for r in self.rows("members").select("batch").distinct().collect())

    def _store(self, name: str, df: DataFrame) -> None:
        """Replaces the partitions of the batches that ``df`` has, from tasks as ``by_batch`` forms them."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.root}/{name}")

    def append(self, deliveries: DataFrame, marks: DataFrame | None = None) -> tuple[list[int], DataFrame]:
        """Takes whole batches in; returns which they are, and (kind, content_id, content, batch) of their contents.

        ``deliveries``: (kind, key, content, batch), one row per delivered content;
        ``marks``: (kind, key, bits, batch), 64-bit hashes of records that
        ``deliveries`` names, too. Batches are appended in their order; a record that an
        earlier batch brought keeps that batch as its ``first``.
        """
        self._runs += 1
        ws, run = self.workspace, self._runs
        named = deliveries.where("key is not null and batch is not null").select("kind", "key", F.nullif("content", F.lit("")).alias("content"), F.col("batch").cast("bigint").alias("batch"))
        rows = ws.put(named.withColumn("content_id", content_id(F.col("content"))), f"deliveries-{run}")
        mine = sorted(r[0] for r in rows.select("batch").distinct().collect())  # a row per batch
        other = lambda name: self.rows(name).where(~F.col("batch").isin(mine))

        # Of history only what the batch mentions is kept: where the batch is small, its side is broadcast and history just read.
        named_here = lambda history, new, on: history.join(new.select(*on).distinct(), on, "left_semi")
        earlier = named_here(other("members").select("kind", "key", "first"), rows, ["kind", "key"])
        # Both sides meet in one shuffle by record, which also serves the distinct and the window.
        mentioned = rows.select("kind", "key", "content_id", "batch", F.col("batch").alias("first")).unionByName(earlier, allowMissingColumns=True).repartition("kind", "key").distinct()
        firsts = mentioned.withColumn("first", F.min("first").over(Window.partitionBy("kind", "key"))).where("batch is not null")
        self._store("members", by_batch(firsts.select("kind", "key", "content_id", "first", "batch")))

        contents = rows.where("content is not null").groupBy("kind", "content").agg(F.min("batch").alias("batch")).withColumn("content_id", content_id(F.col("content")))
        stored = named_here(other("chunks").where("no = 0").select("kind", "content_id"), rows.where("content_id is not null"), ["kind", "content_id"])
        self._store("chunks", cut(by_batch(contents.join(stored, ["kind", "content_id"], "left_anti"))))

        if marks is not None:
            known = marks.where("key is not null and batch is not null and bits is not null").select("kind", "key", "bits", F.col("batch").cast("bigint").alias("batch"))
            first = self.rows("members").where(F.col("batch").isin(mine)).groupBy("kind", "key").agg(F.min("first").alias("first"))
            numbers = known.groupBy("kind", "bits").agg(F.min("batch").alias("batch"))
            self._store("blocks", by_batch(numbers.join(other("marks").select("kind", "bits"), ["kind", "bits"], "left_anti")).select("kind", "bits", F.explode(block_keys(F.col("bits"), BITS_APART)).alias("block_key"), "batch"))
            self._store("marks", by_batch(known.repartition("kind", "key").distinct().join(first, ["kind", "key"])))
        return mine, contents

    def forget_deliveries(self) -> None:
        """Deletes the rows that the last append was read from; its contents cannot be read any more."""
        self.workspace.drop(f"deliveries-{self._runs}")

    def content_pairs(self, chunks: DataFrame, coverage: float = 1.0, exact: bool = False) -> DataFrame:
        """(kind, new, old, covered): contents of appended ``chunks`` and stored contents that share enough bytes.

        A content also covers itself. ``exact`` is a check after the decision: it drops
        covered pairs that are different contents (the same chunks in another order).
        """
        stored = self.rows("chunks")
        probe = chunks
        if coverage < 1.0:
            rarity = stored.groupBy("kind", "chunk").agg(F.count("*").alias("holders"))
            ranked = chunks.join(rarity, ["kind", "chunk"], "left").withColumn("holders", F.coalesce("holders", F.lit(0)))
            before = Window.partitionBy("kind", "content_id").orderBy("holders", "chunk").rowsBetween(Window.unboundedPreceding, -1)
            probe = ranked.withColumn("before", F.coalesce(F.sum("chunk_bytes").over(before), F.lit(0))).where(F.col("before") <= F.col("bytes") * (1.0 - coverage) + 1e-9)
        side = lambda df, name: df.select("kind", "chunk", F.col("content_id").alias(name), F.col("bytes").alias(f"bytes_{name}"))
        pair = ["kind", "new", "old", "bytes_new", "bytes_old"]
        old = stored.select("kind", "chunk", F.col("content_id").alias("old"), F.col("bytes").alias("bytes_old"), F.col("chunk_bytes").alias("shared"))
        met = side(probe, "new").join(old, ["kind", "chunk"])
        if coverage < 1.0:
            # The probe finds the pairs; all their chunks are then counted.
            found = met.select(*pair).distinct()
            met = found.join(side(chunks, "new").drop("bytes_new"), ["kind", "new"]).join(old.drop("bytes_old"), ["kind", "chunk", "old"])
        shared = met.groupBy(*pair).agg(F.sum("shared").alias("shared"))
        covered = (F.col("shared") / F.greatest("bytes_new", "bytes_old")).alias("covered")
        enough = shared.select("kind", "new", "old", covered).where(F.col("covered") >= coverage - 1e-12)
        return enough.where("new = old") if exact else enough

    def number_pairs(self, batches: list[int]) -> DataFrame:
        """(kind, new, old): numbers of some batches and stored numbers that differ in few bits."""
        mine = self.rows("marks").where(F.col("batch").isin(batches)).select("kind", "bits").distinct()
        probe = mine.select("kind", F.col("bits").alias("bits_l"), F.explode(block_keys(F.col("bits"), BITS_APART)).alias("block_key"))
        stored = self.rows("blocks").select("kind", F.col("bits").alias("bits_r"), "block_key")
        return agreeing(probe.join(stored, ["kind", "block_key"]), BITS_APART).select("kind", F.col("bits_l").alias("new"), F.col("bits_r").alias("old"))

    def record_pairs(self, pairs: DataFrame, table: str, value: str, batches: list[int], new: list[int]) -> DataFrame:
        """(kind, key_new, key_old): records of different batches, the later of which came first in one of ``new``; pairs can repeat.

        ``pairs``: (kind, new, old), values of which the new one was delivered in
        ``batches``, by either of the two records: an old record, too, can bring a value
        that later ones had before. ``table`` and ``value`` say where the records of a
        value stand.
        """
        owners = self.rows(table).where(F.col(value).isNotNull())
        side = lambda df, of, n: df.select("kind", F.col(value).alias(of), F.col("key").alias(f"key_{n}"), F.col("first").alias(f"first_{n}"))
        met = pairs.select("kind", "new", "old").join(side(owners.where(F.col("batch").isin(batches)), "new", "a"), ["kind", "new"]).join(side(owners, "old", "b"), ["kind", "old"])
        met = met.where("first_a <> first_b and key_a <> key_b").where(F.greatest("first_a", "first_b").isin(new))
        later = F.col("first_a") > F.col("first_b")
        return met.select("kind", F.when(later, F.col("key_a")).otherwise(F.col("key_b")).alias("key_new"), F.when(later, F.col("key_b")).otherwise(F.col("key_a")).alias("key_old"))

    def ingest(self, deliveries: DataFrame, marks: DataFrame | None = None, coverage: float = 1.0, exact: bool = False, new: list[int] | None = None) -> DataFrame:
        """Appends new batches and returns (kind, key_new, key_old), what they repeat of each other and of all earlier ones.

        ``new`` names the batches whose records are asked for, at least those appended
        here; batches taken in one by one give what they give together if it names all
        of them each time.
        """
        batches, contents = self.append(deliveries, marks)
        new = sorted({*batches, *(new or [])})
        found = self.record_pairs(self.content_pairs(cut(contents), coverage, exact), "members", "content_id", batches, new)
        if marks is not None:
            found = found.unionByName(self.record_pairs(self.number_pairs(batches), "marks", "bits", batches, new))
        return found.distinct()


by_value()
