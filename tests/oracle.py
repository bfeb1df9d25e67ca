"""DuckDB beside Spark on the same tables."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return round(v, 6)
        return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def assert_same(spark, query, sql, sf_dir: str = SF):
    df = query(spark, sf_dir)
    cursor = connect(sf_dir).execute(sql)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(cursor.fetchall(), [d[0] for d in cursor.description])
