"""Physical-plan properties the operators rely on at scale."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from tidepool.plans import registry


def plan(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


# Python evaluation nodes: row-at-a-time (BatchEvalPython) or Arrow UDFs.
PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
            "PythonUDF")


@pytest.mark.parametrize("key", sorted(registry.queries()))
def test_no_python_udf_and_no_cartesian(spark, key):
    p = plan(spark, key)
    assert not any(n in p for n in PY_NODES), p[:2000]
    assert "CartesianProduct" not in p, p[:2000]
    assert "NestedLoopJoin" not in p, p[:2000]


@pytest.mark.parametrize("key", ["top_k", "slow_ops", "top_metric", "log_tail", "match_bm25",
                                 "match_all", "find_one", "sql_topn"])
def test_top_k_is_take_ordered(spark, key):
    assert "TakeOrderedAndProject" in plan(spark, key)


def test_scan_pushes_filters_and_prunes_columns(spark):
    p = plan(spark, "scan_parquet")
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_returnflag), " \
           "GreaterThan(l_quantity,45.0)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double," \
           "l_returnflag:string,l_shipdate" in p
    assert "l_extendedprice" not in p


def test_federated_query_pushes_into_both_sources(spark):
    p = plan(spark, "federated_join")
    assert "FileScan json" in p and "PushedFilters: [In(n_regionkey" in p
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)" in p


def test_bm25_tokenises_once_per_pass(spark):
    from tidepool.operators import search
    from tidepool.sources.tables import load
    docs = load(spark, SF_SMALL, "documents")
    p = search.match(docs, "the osbo")._jdf.queryExecution().executedPlan().toString()
    assert p.count("split(lower(") == 1, p
    # the registered query stages the per-document counts: scoring reads them
    assert "split(lower(" not in plan(spark, "match_bm25")


def test_aggregates_are_partial_before_shuffle(spark):
    for key in ["count_by_desc", "sql_agg", "server_log_parse", "latest_row"]:
        p = plan(spark, key)
        assert "partial_" in p, (key, p[:1500])


@pytest.mark.parametrize("key", ["sql_distinct_on", "sql_lateral"])
def test_top1_per_group_is_limited_before_shuffle(spark, key):
    p = plan(spark, key)
    assert "WindowGroupLimit" in p and "Partial" in p, p[:3000]


def test_recursion_follows_a_chain_of_more_than_100_orders(spark, tmp_path):
    orders = spark.range(112).selectExpr("id AS o_orderkey", "if(id < 109, 1L, 2L) AS o_custkey", "timestamp_ntz '1996-01-01 00:00:00' AS o_orderdate")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    limit = spark.conf.get("spark.sql.cteRecursionLevelLimit", "100")
    rows = E.queries()["sql_recursive"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 109, 109), (2, 3, 3)]
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit", "100") == limit
