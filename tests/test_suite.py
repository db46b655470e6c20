import math

import duckdb
import pytest
from pyspark.sql import functions as F

from polyquery import suite

from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = suite.queries()[name](spark, SF)
    cur = duck.execute(suite.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(suite.queries()) - set(suite.oracle_sql())))
def test_runs(spark, name):
    assert suite.queries()[name](spark, SF).count() > 0


def test_filters_reach_the_scan(spark):
    plan = suite.queries()["property_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "c_acctbal" in plan.split("ReadSchema")[1] and "c_mktsegment" not in plan.split("ReadSchema")[1]


def test_entry(spark):
    assert suite.flagship(spark, SF).count() > 0


@pytest.mark.parametrize(("name", "table", "key", "column"), [("cycle_open_all", "customer", "c_name", "name"), ("optional_open_all", "customer", "c_name", "name"), ("optional_classic_all", "orders", "o_orderkey", "ord"), ("zset_score_join_all", "customer", "c_name", "name"), ("ewma_rtt_all", "events", "user_id", "user_id")])
def test_whole_forms_reach_every_row(spark, name, table, key, column):
    """No customer, order or user of the table is left out; cycles need a supplier in the customer's nation."""
    rows = suite.table(spark, SF, table)
    if name == "cycle_open_all":
        rows = rows.join(suite.table(spark, SF, "supplier"), rows.c_nationkey == F.col("s_nationkey"), "left_semi")
    got = {r[0] for r in suite.queries()[name](spark, SF).select(column).collect()}
    assert got == {r[0] for r in rows.select(key).collect()}


@pytest.mark.parametrize("name", ["cycle_open_all", "rebind_classic"])
def test_hops_from_shared_nodes_are_spread(spark, name):
    """Customers meet the suppliers of a nation in all tasks, not in the one that a small file is read by, and by numbers alone."""
    df = suite.queries()[name](spark, SF)
    assert df.groupBy(F.spark_partition_id()).count().count() > 1
    assert "concat" not in df._jdf.queryExecution().executedPlan().toString()
