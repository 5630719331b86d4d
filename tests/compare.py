"""Order-insensitive comparison of a Spark result with a DuckDB query over the same tables."""

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(x):
    if x is None or str(x) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return float(x)
    return x.isoformat() if hasattr(x, "isoformat") else str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


def assert_same(spark_frame, connection, sql):
    got, wanted = rows(spark_frame.toPandas()), rows(connection.sql(sql).df())
    assert got[0] == wanted[0]
    assert len(got[1]) == len(wanted[1])
    assert got[1] == wanted[1]
