"""What tests of queries share."""

import math

import duckdb

from strataspark.plans.registry import ORACLES, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "documents", "pages", "labels")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def against_duckdb(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    rows = lambda it: sorted((tuple(map(plain, r)) for r in it), key=repr)
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == rows(want.fetchall())
