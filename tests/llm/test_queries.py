"""The queries of the nine problems against their SQL on the smallest tables, and those without SQL for their shape."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from plumbline.llm.oracles import ORACLES
from plumbline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def _value(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = Counter(tuple(_value(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert found or name in ("p1_found",)
        return
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    rows = con.execute(ORACLES[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == columns
    assert found == Counter(tuple(_value(r[names.index(c)]) for c in columns) for r in rows.fetchall())
