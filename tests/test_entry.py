"""Every query against its SQL on the smallest tables."""

import math
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry_module
from tidemark import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def canon(rows):
    key = lambda v: (v is None, str(type(v)), v if v is not None else 0)
    plain = lambda v: v.replace(tzinfo=None) if isinstance(v, datetime) else round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted([tuple(plain(v) for v in r) for r in rows], key=lambda r: [key(v) for v in r])


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_and_sql_agree(spark, db, name):
    df = catalogue.QUERIES[name](spark, DIR)
    want = db.execute(catalogue.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    assert sorted(df.columns) == columns
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert canon(tuple(r) for r in df.select(*columns).collect()) == canon(tuple(r[i] for i in order) for r in want.fetchall())


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 5 and [r.ts for r in rows] == sorted(r.ts for r in rows)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
