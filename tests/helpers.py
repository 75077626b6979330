"""Compare a query's rows with what DuckDB makes of its SQL."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=SF):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if glob.glob(path + '/*') else path}')")
    return c


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if pd.isna(x) if not isinstance(x, (list, dict)) else False:
        return None
    return int(x) if isinstance(x, (bool, float)) and float(x).is_integer() else x


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False, name=None))


def check(query, sql, spark, sf_dir=SF):
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
