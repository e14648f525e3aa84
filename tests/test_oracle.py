"""Every query that has SQL gives DuckDB's rows over the smallest tables."""

import datetime
import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from plenum.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(columns).collect())
    sql = registry.oracle_sql().get(name)
    if not sql:
        assert df.columns
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rel = con.execute(f"SELECT * FROM ({sql})")
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert got == want
    assert got
