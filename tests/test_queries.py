"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from editloom import queries as own
from editloom.plans import views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in views.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(None if r[k] is None or r[k] != r[k] else r[k] for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    got = own.queries()[name](spark, SF)
    want = duck.sql(own.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 56
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["align_fanout", "read_stats", "demultiplex_list"])
def test_few_shuffles_by_read_and_none_by_gene(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = own.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("REPARTITION_BY_NUM") == 2
    dealt = [x.split("hashpartitioning(")[1].split("),")[0] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert not any(x.startswith(("target_gene#", "qseqid#")) and x.count("#") == 1 for x in dealt)
    assert sum(x.startswith("qseqid#") and "sseqid#" in x for x in dealt) == 0
