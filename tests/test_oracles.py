"""Every registered query against its SQL in DuckDB, on the whole tables of one scale factor."""

import glob
import math
import os

import duckdb
import pytest

from driver_queries import duckdb_sql, spark_queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLES = spark_queries.registered(), dict(duckdb_sql.ORACLES)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def comparable(rows):
    def plain(value):
        if isinstance(value, float):
            return "NaN" if math.isnan(value) else repr(value)
        return "" if value is None else f"{type(value).__name__}:{value}"

    return sorted(tuple(plain(v) for v in row) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ours = comparable(df.select(*[f"`{c}`" for c in columns]).collect())
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    theirs = comparable(duck.sql(f"SELECT {picked} FROM ({ORACLES[name]})").fetchall())
    assert len(ours) == len(theirs)
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not different, (len(different), different[:5])
