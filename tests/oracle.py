"""Compare a registered query with its SQL in DuckDB, as sets of rows with repeats."""

import os

import duckdb


def rows_of(frame):
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, values.values.tolist()))


def compare(spark, query, sql, folder):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(folder):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    assert rows_of(query(spark, folder).toPandas()) == rows_of(c.execute(sql).df())
