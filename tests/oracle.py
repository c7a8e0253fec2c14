"""Comparison of a Spark query with its DuckDB twin, order-insensitive."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def compare(spark, query, sql):
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    got, want = query(spark, DATA).toPandas(), con.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for c in columns:
        if got[c].dtype == float:  # whole numbers with nulls come as floats from Spark
            want[c] = want[c].astype(float)
    rows = [sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))) for x in (got, want)]
    assert rows[0] == rows[1]
    return len(got)
