"""Every engine query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from moraine.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return db


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert rows(got) == rows(tables.sql(SQL[name]).df())
    else:
        assert len(got)


def test_checksums_are_those_of_zlib(spark):
    import zlib

    for row in QUERIES["wal_crc32"](spark, DATA).join(spark.read.parquet(f"{DATA}/events.parquet").withColumnRenamed("event_id", "seq"), "seq").limit(50).collect():
        key = f"user_{row['user_id']:012d}".encode()
        value = f"{row['event_type']}|{row['props']}".encode()
        size = lambda x: len(x).to_bytes(4, "little")
        raw = b"\x02" + size(key) + key if row["event_type"] == "error" else b"\x01" + size(key) + key + size(value) + value
        assert row["crc"] == zlib.crc32(raw)


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
