"""Registered queries of the skew-proof operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, ordered, quantiles, rangejoin
from ..sources.tables import load


def window_hot(spark, sf_dir):
    """Ranks and running sums of a key that holds nine tenths of the lines."""
    hot = F.when(F.col("l_orderkey") % 10 < 9, 0).otherwise(F.col("l_orderkey")).alias("k")
    lines = load(spark, sf_dir, "lineitem").select(hot, "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("quantity"))
    whole = ordered.running(lines, ["k"], ["l_shipdate", "l_orderkey", "l_linenumber"], {"running": F.col("quantity")}).drop("rank", "dense_rank")
    return ordered.running(whole.withColumnRenamed("row_number", "n"), ["k"], ["l_shipdate"]).drop("row_number")


def percentile_select(spark, sf_dir):
    """Exact percentiles of prices, by selection."""
    out = quantiles.percentiles(load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.01, 0.25, 0.5, 0.99], ranked=500)
    return out.select("l_returnflag", "l_linestatus", "p", F.round("value", 4).alias("value"))


def chain_doubling(spark, sf_dir):
    """The chain of each customer's orders, as ``sql_recursive`` has it, by pointer doubling."""
    placed = ordered.running(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]) \
        .select("o_custkey", "o_orderkey", "row_number")
    after = placed.select("o_custkey", (F.col("row_number") - 1).alias("row_number"), F.col("o_orderkey").alias("next"))
    links = placed.join(after, ["o_custkey", "row_number"], "left").select(F.col("o_orderkey").alias("node"), "next")
    reached, _ = chains.ends(links)
    return reached.join(placed.select(F.col("o_orderkey").alias("node"), "o_custkey"), "node").groupBy("o_custkey") \
        .agg((F.max("steps") + 1).cast("long").alias("chain_len"), F.count("*").alias("n"))


def range_join_only(spark, sf_dir):
    """Lines by ship date within the spans of some orders, and within one of two centuries."""
    spans = load(spark, sf_dir, "orders").filter("o_orderkey % 500 = 1").select(
        F.col("o_orderkey").alias("span"), F.col("o_orderdate").cast("date").alias("low"),
        F.date_add(F.col("o_orderdate").cast("date"), F.pmod(F.col("o_orderkey"), F.lit(97)).cast("int")).alias("high"))
    long_ = spans.agg(F.lit(-1).cast("long").alias("span"), F.lit("1900-01-01").cast("date").alias("low"), F.lit("2099-12-31").cast("date").alias("high"))
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").cast("long").alias("quantity"))
    return rangejoin.range_join(lines, spans.unionByName(long_), "day", "low", "high").groupBy("span", "low", "high") \
        .agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))


QUERIES = {f.__name__: f for f in (window_hot, percentile_select, chain_doubling, range_join_only)}

from .sql_q import ORACLE as _SQL  # noqa: E402

ORACLE = {
    "window_hot": """
WITH x AS (SELECT CASE WHEN l_orderkey % 10 < 9 THEN 0 ELSE l_orderkey END AS k, l_shipdate, l_orderkey, l_linenumber,
    CAST(l_quantity AS BIGINT) AS quantity FROM lineitem)
SELECT *, row_number() OVER w AS n, CAST(sum(quantity) OVER w AS BIGINT) AS running,
    rank() OVER (PARTITION BY k ORDER BY l_shipdate) AS rank, dense_rank() OVER (PARTITION BY k ORDER BY l_shipdate) AS dense_rank
FROM x WINDOW w AS (PARTITION BY k ORDER BY l_shipdate, l_orderkey, l_linenumber)""",
    "percentile_select": """
SELECT l_returnflag, l_linestatus, p, round(CASE p WHEN 0.01 THEN a WHEN 0.25 THEN b WHEN 0.5 THEN c ELSE d END, 4) AS value FROM (
  SELECT l_returnflag, l_linestatus, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.01) AS a, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.25) AS b,
    quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) AS c, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.99) AS d
  FROM lineitem GROUP BY ALL), (SELECT unnest([0.01, 0.25, 0.5, 0.99]::DOUBLE[]) AS p)""",
    "chain_doubling": _SQL["sql_recursive"],
    "range_join_only": """
WITH s AS (SELECT o_orderkey AS span, CAST(o_orderdate AS DATE) AS low, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 97 AS INTEGER) AS high
    FROM orders WHERE o_orderkey % 500 = 1 UNION ALL SELECT -1, DATE '1900-01-01', DATE '2099-12-31')
SELECT span, low, high, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem JOIN s ON CAST(l_shipdate AS DATE) BETWEEN low AND high GROUP BY span, low, high""",
}
