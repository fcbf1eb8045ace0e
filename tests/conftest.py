"""One Spark session for all tests, and the comparison of a query with its SQL on DuckDB."""

from __future__ import annotations

import math
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    """Sorted rows with the columns in the order of their names."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    out = con.execute(sql)
    columns = [d[0] for d in out.description]
    return sorted(columns), rows_of(columns, out.fetchall())


def same_as_sql(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    columns, want = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == columns
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
