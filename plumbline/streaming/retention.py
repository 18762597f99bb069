"""Incremental top-k: candidates kept per source while shards arrive.

A file stream hands over the shards; each micro-batch is merged with what the batch
before it kept and cut to the quota again. The top k of a union is the top k of the
tops, so the result is that of one pass over everything. The kept rows of batch n lie in
their own folder, written beside it and renamed when whole; the folder of batch n - 1 is
derived from the number alone, so a batch that is replayed, or a stream that is started
again, reads and writes what it did before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.selection import source_quotas
from plumbline.operators.validate import duplicates, require_empty
from plumbline.session import Workspace

_KEPT = "source string, key string"


def retained(spark: SparkSession, path: str, schema: str, prepare: Callable[[DataFrame], DataFrame], quotas: dict[str, int], seed: str, workspace: Workspace, reserve: int = 0, files_per_batch: int = 1, redelivered: bool = False) -> DataFrame:
    """The kept (source, key) after all shards below ``path``; ``prepare`` maps a batch to (source, key).

    A key that occurs twice in a batch, or in it and among the kept, is an error. With
    ``redelivered``, shards may bring again what earlier ones brought: (source, key)
    counts once, and a key in each source that it came with.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    jvm = spark._jvm

    def at(name: str):
        place = jvm.org.apache.hadoop.fs.Path(workspace.path(name))
        return place.getFileSystem(spark._jsc.hadoopConfiguration()), place

    def exists(name: str) -> bool:
        system, place = at(name)
        return system.exists(place)

    def merge(batch: DataFrame, number: int) -> None:
        rows = prepare(batch).where("source is not null and key is not null").select("source", "key")
        if number > 0:
            rows = rows.unionByName(batch.sparkSession.read.schema(_KEPT).parquet(workspace.path(f"kept-{number - 1}")))
        if redelivered:
            rows = rows.distinct()
        else:
            require_empty(duplicates(rows, ["key"]), "a key twice")
        best = source_quotas(rows, quotas, seed, reserve).select("source", "key")
        best.write.mode("overwrite").parquet(workspace.path(f"new-{number}"))
        system, place = at(f"kept-{number}")
        system.delete(place, True)
        system.rename(at(f"new-{number}")[1], place)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", workspace.path("stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = -1
    while exists(f"kept-{last + 1}"):
        last += 1
    return spark.createDataFrame([], _KEPT) if last < 0 else spark.read.schema(_KEPT).parquet(workspace.path(f"kept-{last}"))
