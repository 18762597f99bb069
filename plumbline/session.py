"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str = "local[*]", app: str = "plumbline", **conf: str) -> SparkSession:
    """A session with the settings that the engine is tested under; ``conf`` overrides them."""
    builder = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where none is named, local mode sets a temporary folder of this machine once; on a
    cluster that would not be shared, so there it is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        current = context.getCheckpointDir()
    return str(current).rstrip("/")


class Workspace:
    """Tables written once to the shared folder, to cut lineage and to be read several times.

    They survive the loss of executors, which cached or locally checkpointed data do
    not. The DataFrames that are returned to the caller still read from the folder, so
    it stays until the caller says ``release``, or until the driver's Python ends.
    """

    open: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex[:12]}"
        Workspace.open.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def put(self, df: DataFrame, table: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> DataFrame:
        """Writes ``df`` as Parquet and returns the DataFrame that reads it again."""
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(table))
        return self.get(table, df)

    def get(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, table: str | None = None) -> None:
        """Deletes one table or, without a name, everything."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root if table is None else self.path(table))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            self.drop()
        except Exception:  # the JVM may already be gone
            pass


def release() -> None:
    """Deletes the tables of all queries so far, whose results must have been read or written by then."""
    while Workspace.open:
        Workspace.open.pop().close()


atexit.register(release)
