"""Every match query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pytest

from pitchflow.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = ("orders", "events", "documents", "embeddings", "pages", "conversations", "part")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    result = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    got = registry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    mine = Counter(tuple(plain(v) for v in r) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    assert mine == Counter(tuple(plain(v) for v in r) for r in result.fetchall())
