"""A query's rows beside its SQL's, as the driver compares them: sorted columns, any order of rows."""

import numbers
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, numbers.Number) and not isinstance(v, (bool, np.bool_)):
            return repr(round(float(v), 9))
        return str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def check(spark, sf_dir: str, query, sql: str) -> int:
    mine, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    assert a == b
    return len(a)
