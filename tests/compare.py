"""Runs a query and its SQL side by side."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def same(df, sql, sf_dir):
    a, b = df.toPandas(), duck(sf_dir).sql(sql).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].astype(object).where(x[columns].notna(), None) for x in (a, b))
    rows = [sorted((tuple(str(pd.Timestamp(v).date()) if hasattr(v, "year") else round(float(v), 6) if isinstance(v, float) else v for v in r) for r in x.itertuples(index=False)), key=str) for x in (a, b)]
    assert rows[0] == rows[1]
