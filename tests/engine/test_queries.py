"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from lattix import queries, queries_io  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(found):
    return sorted(tuple("NULL" if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = duck.sql(queries.SQL[name])
    assert sorted(want.columns) == names
    got = df.select(*[f"`{n}`" for n in names]).collect()
    assert rows(got) == rows(want.select(*[f'"{n}"' for n in names]).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_give_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_without_the_corpus_operators():
    code = "import sys; sys.modules['lattix.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_plans_push_down_and_shuffle_once(spark):
    """Filters and columns reach the scan, a reduction shuffles partial sums, a series shuffles once by pixel."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(queries.QUERIES["reduce_time_mean"](spark, DATA))
    assert "partial_avg" in p and "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_discount:double,l_shipdate:timestamp_ntz>" in p
    assert "GreaterThanOrEqual(l_shipdate,1995-01-01T00:00" in p and "LessThan(l_shipdate,2002-01-01T00:00" in p
    c = plan(queries.QUERIES["crop_index"](spark, DATA))  # a crop narrows the scan
    assert "GreaterThanOrEqual(ts,2024-01-04T00:00" in c and "LessThan(ts,2024-01-14T00:00" in c
    assert "GreaterThanOrEqual(ts,2024-01-10T00:00" in plan(queries.QUERIES["slice_time"](spark, DATA))
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00" in plan(queries.QUERIES["pixel_agg_mean"](spark, DATA))
    w = plan(queries._value(spark, DATA).fill_time("linear").df)
    assert w.count("Exchange hashpartitioning(iy") == 1
    z = plan(queries.QUERIES["zonal_statistics"](spark, DATA))
    assert "CartesianProduct" not in z and "NestedLoop" not in z


def test_time_series_of_all_places(spark):
    ids = queries.QUERIES["query_timeseries"](spark, DATA).select("id").distinct().count()
    assert ids == spark.read.parquet(f"{DATA}/customer.parquet").select("c_custkey").distinct().count()
