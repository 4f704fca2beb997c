"""Every catalog query against its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from barlab.plans import registry as catalog

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
TABLES = ["customer", "documents", "events", "labels", "lineitem", "orders", "part"]


def shown(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 5) if isinstance(value, float) else value


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = catalog.queries()[name](spark, str(SF))
    columns = sorted(frame.columns)
    got = [tuple(shown(r[c]) for c in columns) for r in frame.collect()]
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    key = lambda row: tuple(str(x) for x in row)
    assert sorted(got, key=key) == sorted((tuple(shown(x) for x in row) for row in want), key=key)
