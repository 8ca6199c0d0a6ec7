"""Every query with SQL gives the rows and types that DuckDB gives."""

import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

from millrace.catalogue import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, Decimal)):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) else float(f"{v:.12g}"))
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, date) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    if q.sql is None:
        assert ours
        return
    rel = duck.sql(q.sql)
    assert sorted(rel.columns) == names
    theirs = dict(zip(rel.columns, map(str, rel.types), strict=True))
    at = [rel.columns.index(n) for n in names]
    assert {n: FAMILY.get(t, t) for n, t in df.dtypes} == theirs
    assert ours == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
