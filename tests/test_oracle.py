"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from keystrata.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="needs the shared tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DIR)
    columns = sorted(frame.columns)
    got = sorted(str([r[c] for c in columns]) for r in frame.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    wanted = duck.sql(ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert got == sorted(str([r[i] for i in at]) for r in wanted.fetchall())


def test_entry_runs_without_the_optional_package(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_reads_only_events_on_any_scheme(spark):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own.link./in", f"file://{DIR}")
    got, wanted = (QUERIES["stream_latest"](spark, where).collect() for where in ("viewfs://own/in", DIR))
    assert sorted(got, key=str) == sorted(wanted, key=str)
