"""The queries with SQL of their own against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandline.llm import queries

SF = "/root/testdata/sf0.001"


def both(name, spark, sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, want = queries.queries()[name](spark, sf).toPandas(), c.sql(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False)) for df in (got, want)]
    return got, *rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(name, spark):
    _, got, want = both(name, spark, SF)
    assert got == want


def test_quality_rules_reject_documents_where_labels_are_enough(spark):
    table, got, want = both("op8_quality_rules", spark, "/root/testdata/sf0.1")
    assert got == want
    assert (~table["kept"] & ~table["base_failed"]).sum() > 100 and table["kept"].mean() > 0.5


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
