"""Images of pages: which to score, scoring in batches, and putting results back in place."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.compare import WHITE_SPACE
from plumbline.functions.paths import canonical_source, error_code, error_message
from plumbline.shipping import by_value

#: Limits of one image: bytes, pixels a side, pixels (fixed values).
MOST_BYTES, MOST_SIDE, MOST_PIXELS = 20 * 1024 * 1024, 8192, 16 * 1024 * 1024
#: Means and standard deviations of the three colour channels (fixed values).
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)

#: A scorer takes a batch and returns one (status, confidence, code, message) per row.
Scorer = Callable[[pd.DataFrame], list[tuple[str, float | None, str | None, str | None]]]


def elements(images: DataFrame) -> DataFrame:
    """(page_id, pos, source, alt): each image with its canonical source, null if unsupported.

    ``images``: page_id, pos, current_src, src, alt. The current source counts unless it
    is blank.
    """
    named = F.when(F.btrim("current_src", F.lit(WHITE_SPACE)) != "", F.col("current_src")).otherwise(F.col("src"))
    return images.select("page_id", "pos", canonical_source(named).alias("source"), F.btrim(F.coalesce("alt", F.lit("")), F.lit(WHITE_SPACE)).alias("alt"))


def image_plan(images: DataFrame) -> DataFrame:
    """(page_id, id, source, alt, first_pos, elements): one request per distinct source of a page.

    Ids count sources by first occurrence; the alternative text is the first one's.
    """
    per = elements(images).where("source is not null").groupBy("page_id", "source").agg(F.min("pos").alias("first_pos"), F.min_by("alt", F.struct("pos", "alt")).alias("alt"), F.count("*").alias("elements"))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("first_pos", "source"))
    return per.select("page_id", F.concat(F.lit("image-"), number.cast("string")).alias("id"), "source", "alt", "first_pos", "elements")


def scan_summary(images: DataFrame, plan: DataFrame, results: DataFrame) -> DataFrame:
    """(page_id, count, errors, skipped): supported images, those whose source failed (per image), unsupported ones."""
    placed = elements(images).join(plan.select("page_id", "source", "id"), ["page_id", "source"], "left").join(results.select("page_id", "id", "status"), ["page_id", "id"], "left")
    n = lambda c: F.sum(c.cast("int")).cast("bigint")
    return placed.groupBy("page_id").agg(n(F.col("source").isNotNull()).alias("count"), n(F.coalesce(F.col("status") == "error", F.lit(False))).alias("errors"), n(F.col("source").isNull()).alias("skipped"))


def within_limits(size: Column, width: Column, height: Column) -> Column:
    return size.between(1, MOST_BYTES) & width.between(1, MOST_SIDE) & height.between(1, MOST_SIDE) & (width.cast("bigint") * height <= MOST_PIXELS)


def merge_results(requests: DataFrame, scored: DataFrame, blocked: DataFrame) -> DataFrame:
    """Results of allowed and blocked images with ``place``, the request's number on its page, to order them by."""
    both = scored.unionByName(blocked, allowMissingColumns=True)
    return requests.join(both, ["page_id", "id"]).withColumn("place", F.substring_index("id", "-", -1).cast("bigint"))


def fan_out(images: DataFrame, plan: DataFrame, results: DataFrame) -> DataFrame:
    """(page_id, pos, id, status): the one result of a source given to every image that shows it."""
    placed = elements(images).where("source is not null").join(plan.select("page_id", "source", "id"), ["page_id", "source"])
    return placed.join(results.select("page_id", "id", "status"), ["page_id", "id"]).select("page_id", "pos", "id", "status")


class _Images(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "img":
            named = {k: v or "" for k, v in reversed(attrs)}  # of a repeated attribute the first counts
            self.found.append((named.get("src", ""), named.get("alt", "")))


def html_images(pages: DataFrame) -> DataFrame:
    """(page_id, pos, current_src, src, alt): the img elements of ``html`` in document order, from 0.

    A parsed page has no current source yet, so that is empty. Null pages have no images.
    """
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, pos bigint, current_src string, src string, alt string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                parser = _Images()
                parser.feed(html or "")
                parser.close()
                rows.extend((page, i, "", src, alt) for i, (src, alt) in enumerate(parser.found))
            yield pd.DataFrame(rows, columns=["page_id", "pos", "current_src", "src", "alt"])

    return pages.select("page_id", "html").mapInPandas(run, schema)


def unavailable(batch: pd.DataFrame) -> list[tuple]:
    """The scorer that stands in while none is configured."""
    return [("error", None, "MODEL_RUNTIME_UNAVAILABLE", "no model is configured")] * len(batch)


def score(df: DataFrame, keys: list[str], make_scorer: Callable[[], Scorer] = lambda: unavailable) -> DataFrame:
    """(keys..., status, confidence, code, message) by Arrow batches.

    The scorer is made once per Python worker. A batch that fails is scored row by row,
    so that one bad row costs only itself.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", status string, confidence double, code string, message string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            try:
                rows = scorer(batch)
            except Exception:
                rows = []
                for i in range(len(batch)):
                    try:
                        rows.extend(scorer(batch.iloc[i : i + 1]))
                    except Exception as error:
                        rows.append(("error", None, None, str(error)))
            out = batch[keys].reset_index(drop=True)
            for n, name in enumerate(("status", "confidence", "code", "message")):
                out[name] = pd.Series([r[n] for r in rows], dtype="float64" if name == "confidence" else "object")
            yield out

    # What a failure means is said once, by the column functions.
    failed = (F.col("status") == "error") & F.col("code").isNull()
    rows = df.mapInPandas(run, schema).withColumn("message", F.when(failed, error_message(F.coalesce("message", F.lit("")))).otherwise(F.col("message")))
    return rows.withColumn("code", F.when(failed, error_code(F.col("message"))).otherwise(F.col("code")))


def linear_scorer(weights: list[float], bias: float = 0.0, column: str = "embedding") -> Callable[[], Scorer]:
    """Makes a scorer that applies the logistic function to a weighted sum of an array column."""

    def make() -> Scorer:
        w = np.asarray(weights)

        def scorer(batch: pd.DataFrame) -> list[tuple]:
            x = np.stack(batch[column].to_numpy())
            z = x @ w + bias
            return [("ok", float(p), None, None) for p in 1 / (1 + np.exp(-np.clip(z, -700, 700)))]

        return scorer

    return make


def planar_pixels(df: DataFrame, keys: list[str], column: str = "rgba") -> DataFrame:
    """(keys..., pixels ARRAY<FLOAT>): interleaved RGBA bytes as normalised planes of R, G and B."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", pixels array<float>"
    mean, deviation = np.array(MEAN)[:, None], np.array(DEVIATION)[:, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            planes = [((np.frombuffer(bytes(b), np.uint8).reshape(-1, 4)[:, :3].T / 255.0 - mean) / deviation).astype(np.float32).ravel() for b in batch[column]]
            yield batch[keys].assign(pixels=planes)

    return df.mapInPandas(run, schema)


by_value()
