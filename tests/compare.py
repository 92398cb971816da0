"""Row comparison of a Spark query with its DuckDB SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 6) if isinstance(x, float) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(value(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


def assert_same(spark_frame, sql: str, sf_dir: str):
    got, want = rows(spark_frame.toPandas()), rows(duck(sf_dir).execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
