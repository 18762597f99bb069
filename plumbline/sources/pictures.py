"""Files of pictures: reading, fetching, transforming and writing them."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.hashing import content_digest
from plumbline.shipping import by_value

#: How often a download is tried; the pause doubles each time.
TRIES = 5


def read_pictures(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, content_sha256, content) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), content_digest("content").alias("content_sha256"), "content")


def transformed(df: DataFrame, column: str, transform: Callable[[bytes], bytes]) -> DataFrame:
    """``df`` with the transform applied to a binary column, by Arrow batches; null stays null."""

    @F.pandas_udf("binary")
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else transform(bytes(b)))

    return df.withColumn(column, apply(column))


def fetched(df: DataFrame, url: str, fetch: Callable[[str], bytes], tries: int = TRIES, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """``df`` with ``content``, what ``fetch`` gives for each URL. Failures are tried again; an empty answer is an error."""

    @F.pandas_udf("binary")
    def get(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(address: str) -> bytes:
            for i in range(tries):
                try:
                    data = fetch(address)
                    break
                except OSError:
                    if i == tries - 1:
                        raise
                    pause(float(2**i))
            if not data:
                raise ValueError(f"an empty picture: {address}")
            return data

        for urls in batches:
            yield urls.map(lambda u: None if u is None else one(u))

    return df.withColumn("content", get(url))


def write_pictures(df: DataFrame, folder: str, path: str = "local_path", content: str = "content") -> None:
    """Writes every row's bytes to its relative path below a folder that all executors share.

    A file appears whole or not at all: it is written beside its place and renamed, so
    a task that is run again replaces it by the same bytes.
    """

    def write(rows: Iterator[Row]) -> None:
        for row in rows:
            target = Path(folder) / row[path]
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(f"{target.name}.{os.getpid()}.part")
            part.write_bytes(bytes(row[content]))
            os.replace(part, target)

    df.select(path, content).foreachPartition(write)


by_value()
