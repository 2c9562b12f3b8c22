"""Comparing a Spark result with DuckDB's on the same tables."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str | bytes | datetime.date):
        return v
    if isinstance(v, decimal.Decimal | int | float):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    out = [tuple(_cell(r[k]) for k in order) for r in data]
    return [names[k] for k in order], sorted(out, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


def same(spark_df, connection, sql):
    cursor = connection.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    got = rows(spark_df.columns, spark_df.collect())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]), [x for x in got[1] if x not in want[1]][:3], [x for x in want[1] if x not in got[1]][:3])
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not wrong, wrong[:3]
    return len(got[1])
