"""Canonical JSON documents: digests, exact keys, lists that become tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DocumentError(ValueError):
    """A document that is not what it should be."""


def canonical(value: Any, indent: int | None = None) -> bytes:
    """Sorted keys, ASCII escapes, one newline at the end; no spaces, or lines with an indent."""
    separators = (",", ":") if indent is None else (",", ": ")
    return (json.dumps(value, sort_keys=True, separators=separators, indent=indent, ensure_ascii=True, allow_nan=False) + "\n").encode("ascii")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def load(path: str | Path, expected_sha256: str | None = None, keys: set[str] | None = None, must_be_canonical: bool = False, indent: int | None = None) -> dict:
    """Reads one document, checking the digest of its bytes, its exact keys, its version and its form."""
    data = Path(path).read_bytes()
    if expected_sha256 is not None and sha256(data) != expected_sha256:
        raise DocumentError(f"{path}: the digest differs")
    try:
        document = json.loads(data)
    except ValueError as error:
        raise DocumentError(f"{path}: no JSON") from error
    if not isinstance(document, dict) or (keys is not None and set(document) != keys):
        raise DocumentError(f"{path}: unexpected keys")
    if document.get("schema_version", 1) != 1:
        raise DocumentError(f"{path}: unknown version")
    if must_be_canonical and canonical(document, indent) != data:
        raise DocumentError(f"{path}: not in canonical form")
    return document


def check_lineage(expected: dict[str, str], actual: dict[str, str]) -> None:
    """Raises unless both name the same digests; the first three names that differ are told."""
    wrong = sorted(n for n in expected.keys() | actual.keys() if expected.get(n) != actual.get(n))
    if wrong:
        raise DocumentError(f"lineage differs: {wrong[:3]}")


def rows_of(spark: SparkSession, document: dict, field: str, schema: str) -> DataFrame:
    """A list of objects in a document as a table; every object must have exactly the schema's fields."""
    empty = spark.createDataFrame([], schema)
    names = set(empty.columns)
    entries = document.get(field)
    if not isinstance(entries, list) or any(not isinstance(e, dict) or set(e) != names for e in entries):
        raise DocumentError(f"{field}: entries with unexpected keys")
    return spark.createDataFrame([tuple(e[c] for c in empty.columns) for e in entries], schema)


def assignments_of(spark: SparkSession, document: dict) -> DataFrame:
    """(sample_id, split) of a split document."""
    assignments = document.get("assignments")
    if not isinstance(assignments, dict) or any(v not in ("train", "validation", "calibration") for v in assignments.values()):
        raise DocumentError("assignments: unknown split")
    return spark.createDataFrame(sorted(assignments.items()), "sample_id string, split string")


def prior_manifest(path: str | Path, dataset: str, revision: str) -> tuple[list[str], list[str]]:
    """Sorted file names and content digests of an earlier holdout, which must be of this dataset and revision and repeat neither."""
    document = load(path)
    if (document.get("dataset_id"), document.get("dataset_revision")) != (dataset, revision):
        raise DocumentError(f"{path}: another dataset or revision")
    entries = document.get("entries")
    if not isinstance(entries, list) or any(not isinstance(e, dict) or not isinstance(e.get("file_name"), str) or not isinstance(e.get("content_sha256"), str) for e in entries):
        raise DocumentError(f"{path}: entries without name or content")
    names, contents = ([e[k] for e in entries] for k in ("file_name", "content_sha256"))
    if len(set(names)) < len(names) or len(set(contents)) < len(contents):
        raise DocumentError(f"{path}: a name or content twice")
    return sorted(names), sorted(contents)


def _parts(df: DataFrame, head: dict, field: str, key: str, values: bool = False) -> Iterator[bytes]:
    """The canonical document piece by piece; the driver holds one partition and not the whole list."""
    marker = "@rows@"
    before, after = canonical({**head, field: marker}).decode().split(json.dumps(marker))
    yield before.encode() + b"["
    for i, row in enumerate(df.orderBy(key).toLocalIterator()):
        yield (b"," if i else b"") + canonical(row[key] if values else row.asDict(recursive=True))[:-1]
    yield b"]" + after.encode()


def rows_digest(df: DataFrame, head: dict, field: str, key: str, values: bool = False) -> str:
    """The digest of the document that ``write_rows`` would write; with ``values`` its list holds the keys alone."""
    digest = hashlib.sha256()
    for data in _parts(df, head, field, key, values):
        digest.update(data)
    return digest.hexdigest()


def write_rows(df: DataFrame, path: str | Path, head: dict, field: str, key: str) -> str:
    """Writes a document whose list is ``df`` sorted by ``key``, and returns its digest. The file must not exist yet."""
    digest = hashlib.sha256()
    with Path(path).open("xb") as out:
        for data in _parts(df, head, field, key):
            digest.update(data)
            out.write(data)
    return digest.hexdigest()


def partition_digest(assignments: DataFrame, split: str) -> str:
    """The digest of the sorted sample ids that ``assignments`` (sample_id, split) gives to one split; none is an error."""
    mine = assignments.where(F.col("split") == split).select("sample_id")
    if not mine.limit(1).collect():
        raise DocumentError(f"no sample in {split}")
    return rows_digest(mine, {"schema_version": 1, "split": split}, "sample_ids", "sample_id", values=True)
