"""Every query with SQL of its own, Spark against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(df):
    columns = sorted(df.columns)
    rows = df[columns].astype(object).where(df[columns].notna(), None).values.tolist()
    return columns, sorted(tuple("~" if x is None else f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, spark, duck):
    got, want = plain(queries.QUERIES[name](spark, SF).toPandas()), plain(duck.sql(queries.ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"explained"}  # a plan is no table that SQL could say
    assert "Scan parquet" in queries.QUERIES["explained"](spark, SF).first()[0]


def test_no_duplicated_kernels_and_pruned_scans(spark):
    plan = queries.merge_summary(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    scan = queries.QUERIES["sql_scan_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in scan and "l_returnflag" not in scan.split("ReadSchema")[1]


def test_small_blocks_of_a_pair_of_files_share_tasks(spark, tmp_path):
    spark.range(3000).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    made = queries.QUERIES["merge_files"](spark, str(tmp_path))
    assert made.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert made.count() == 3000
