"""Every query with SQL gives the SQL's rows; the others give a stable schema."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarrylode.plans import live_queries, report_queries, site_queries  # noqa: F401
from quarrylode.plans.queries import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    wanted = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert sorted(names) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(plain(r[c]) for c in cols) for r in wanted), key=repr)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
