"""Runs a query and its SQL on the same folder and compares their rows."""

import glob
import os
import warnings

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder=DATA):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def same(spark, query, sql, folder=DATA):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = connection(folder).execute(sql).to_arrow_table()
    got = query(spark, folder).toArrow()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    as_rows = lambda t: sorted(map(repr, zip(*[t[c].to_pylist() for c in columns], strict=True)))
    assert as_rows(got) == as_rows(want)
