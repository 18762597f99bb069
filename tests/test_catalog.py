"""The catalog's queries against their SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from plumbline.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_catalog_is_reached():
    assert catalog.FLAGSHIP in catalog.QUERIES
    assert catalog.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert catalog.ORACLES.keys() <= catalog.QUERIES.keys()


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    whole, *each = sorted(rows, key=lambda r: r["source"] or "")
    assert whole["source"] is None and whole["count"] == sum(r["count"] for r in each) > 0


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_same_as_sql(spark, name):
    found = Counter(tuple(r) for r in catalog.QUERIES[name](spark, FOLDER).collect())
    if name not in catalog.ORACLES:
        assert found
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    assert found == Counter(con.execute(catalog.ORACLES[name]).fetchall())
