"""A Spark result against its DuckDB SQL, as the driver compares them: by sorted columns, in any order of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder=SF):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: "-" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in records)


def check(spark, con, function, sql, folder=SF):
    got = function(spark, folder)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    found = con.sql(sql)
    assert mine == rows(found.columns, found.fetchall())
    return len(mine[1])
