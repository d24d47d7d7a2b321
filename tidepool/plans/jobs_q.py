"""Registered job and federation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs
from ..operators.federate import Source, federated_sql
from ..session import work_path
from ..sources import jsonio
from ..sources.tables import load, table_path


def pi_estimate(spark, sf_dir):
    """Pi from one deterministic point per lineitem row (the sample grows with the table)."""
    li = load(spark, sf_dir, "lineitem")
    x, y = jobs.congruential_point(F.col("l_orderkey"), F.col("l_linenumber").cast("bigint"))
    r = jobs.pi_from_points(li.select(x.alias("x"), y.alias("y")))
    return r.select("samples", F.round("pi", 10).alias("pi"))


FEDERATED_SQL = """
SELECT n.n_name, c.c_mktsegment, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance
FROM fed_customer c JOIN fed_nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_acctbal > 0 AND n.n_regionkey IN (1, 3)
GROUP BY n.n_name, c.c_mktsegment
"""


def federated_join(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    exported = work_path(spark, "relational", "nation")
    jsonio.export_json(nation, exported)  # the second system's copy of the table
    return federated_sql(spark, {
        "fed_nation": Source("json", exported, schema=nation.schema),
        "fed_customer": Source("parquet", table_path(sf_dir, "customer")),
    }, FEDERATED_SQL)


QUERIES = {
    "pi_estimate": pi_estimate,
    "federated_join": federated_join,
}

ORACLE = {
    "pi_estimate": """
SELECT count(*) AS samples,
       round(4.0 * avg(CASE WHEN x * x + y * y <= 1.0 THEN 1.0 ELSE 0.0 END), 10) AS pi
FROM (SELECT CAST((l_orderkey * 7919 + CAST(l_linenumber AS BIGINT) * 104729) % 10007 AS DOUBLE)
               / 10007.0 AS x,
             CAST((l_orderkey * 104723 + CAST(l_linenumber AS BIGINT) * 7927) % 10009 AS DOUBLE)
               / 10009.0 AS y
      FROM lineitem)""",
    "federated_join": FEDERATED_SQL.replace("fed_customer", "customer")
                                   .replace("fed_nation", "nation"),
}
