"""Registered document queries (Q02-Q07, Q10) and their DuckDB oracles.

Table stand-ins (see FIXTURES.md part C): ``customer`` plays the users
collection (c_acctbal is the compared number, c_name the lookup key) and
``events`` the profiled operations (value = millis, event_type = operation).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import docquery as Q
from ..sources.tables import load

# Parameters of the registered queries.
QUANTITY = 25.0  # occurs in the data, so >= and > differ
LOOKUP_NAME = "Customer#000000007"


def find_all(spark, sf_dir):
    return Q.find_all(load(spark, sf_dir, "customer"))


def find_gte(spark, sf_dir):
    return Q.find_gte(load(spark, sf_dir, "lineitem"), "l_quantity", QUANTITY) \
        .select("l_orderkey", "l_linenumber", "l_quantity")


def find_gt(spark, sf_dir):
    return Q.find_gt(load(spark, sf_dir, "lineitem"), "l_quantity", QUANTITY) \
        .select("l_orderkey", "l_linenumber", "l_quantity")


def find_one(spark, sf_dir):
    return Q.find_one(load(spark, sf_dir, "customer"), "c_name", LOOKUP_NAME, "c_custkey")


def count_docs(spark, sf_dir):
    return Q.count_docs(load(spark, sf_dir, "events"),
                        named={"n_all": None, "n_purchase": F.col("event_type") == "purchase"})


def project(spark, sf_dir):
    ev = load(spark, sf_dir, "events").withColumn("doc", F.from_json("props", "k BIGINT"))
    return Q.project(ev, ["event_id", "user_id", F.col("doc.k").alias("k")])


def top_k(spark, sf_dir):
    return Q.top_k(load(spark, sf_dir, "events"), "ts", 10, "event_id") \
        .select("event_id", "ts", "event_type")


def slow_ops(spark, sf_dir):
    ops = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("op_id"), "ts", F.col("event_type").alias("op"),
        F.col("value").alias("millis"))
    return Q.slow_ops(ops)


QUERIES = {
    "find_all": find_all,
    "find_gte": find_gte,
    "find_gt": find_gt,
    "find_one": find_one,
    "count_docs": count_docs,
    "project": project,
    "top_k": top_k,
    "slow_ops": slow_ops,
}

ORACLE = {
    "find_all": "SELECT * FROM customer",
    "find_gte": f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
                f"WHERE TRY_CAST(l_quantity AS DOUBLE) >= {QUANTITY}",
    "find_gt": f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem "
               f"WHERE TRY_CAST(l_quantity AS DOUBLE) > {QUANTITY}",
    "find_one": f"SELECT * FROM customer WHERE c_name = '{LOOKUP_NAME}' "
                f"ORDER BY c_custkey LIMIT 1",
    "count_docs": "SELECT count(*) AS n_all, count(*) FILTER (WHERE event_type = 'purchase') "
                  "AS n_purchase FROM events",
    "project": "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k "
               "FROM events",
    "top_k": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 10",
    "slow_ops": "SELECT event_id AS op_id, ts, event_type AS op, value AS millis FROM events "
                "WHERE value > 100 ORDER BY ts DESC, event_id DESC LIMIT 10",
}
