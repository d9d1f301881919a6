"""Comparison of a query with its SQL, as the driver does it: columns by name, rows in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
        return None
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") and not hasattr(v, "__len__") else v


def rows(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=repr)


def assert_same(spark, con, query, sql, sf_dir):
    mine, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
