"""Registered snapshot queries (B01-B04) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshot as B
from ..session import work_path
from ..sources.tables import load
from .catalog_q import fresh_db

# The "now" of the retention check on events-as-snapshots.
RETENTION_NOW = "2024-01-20 12:00:00"


def snapshot_manifest(spark, sf_dir):
    names = ["nation", "region", "orders"]
    src = {t: load(spark, sf_dir, t) for t in names}
    root = work_path(spark, "snapshots")
    sid = B.backup(spark, src, root, db="tpch")
    m = B.manifest(spark, root).filter(F.col("snapshot_id") == sid)
    sums = None
    for t, df in src.items():
        s = df.agg(B.checksum(df).alias("src_sum")).select(F.lit(t).alias("table"), "src_sum")
        sums = s if sums is None else sums.unionByName(s)
    return (m.join(sums, "table")
            .select("table", "rows", (F.col("checksum") == F.col("src_sum")).alias("checksum_ok")))


def snapshot_restore(spark, sf_dir):
    root = work_path(spark, "snapshots")
    sid = B.backup(spark, {"orders": load(spark, sf_dir, "orders")}, root, db="tpch")
    target = fresh_db(spark, "restored")
    return B.restore(spark, root, sid, target)["orders"]


def snapshot_retention(spark, sf_dir):
    snaps = load(spark, sf_dir, "events").select(
        F.col("event_id").alias("snapshot_id"), F.col("ts").alias("created"))
    now = F.lit(RETENTION_NOW).cast("timestamp")
    return B.expired(snaps, now=now)


def _changed_orders(orders):
    bump = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    changed = orders.withColumn(
        "o_totalprice", F.when(bump, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    dup = orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"))
    return changed.unionByName(dup)


def snapshot_diff(spark, sf_dir):
    a = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice",
                                               "o_orderpriority")
    b = _changed_orders(a)
    return B.diff(a, b)


def snapshot_diff_tree(spark, sf_dir):
    """The same difference from two trees of checksums; equal folders are not read."""
    a = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    paths = [work_path(spark, "tree", side) for side in "ab"]
    for df, path in zip((a, _changed_orders(a)), paths):
        B.write_tree(df, path)
    return B.diff_tree(spark, *paths)


def snapshot_expire(spark, sf_dir):
    """Three snapshots, of which the one older than seven days goes."""
    root, taken = work_path(spark, "snapshots"), {"old": "2024-01-10 00:00:00", "week": "2024-01-13 00:00:00", "new": "2024-01-20 00:00:00"}
    for sid, at in taken.items():
        B.backup(spark, {"nation": load(spark, sf_dir, "nation"), "orders": load(spark, sf_dir, "orders")}, root, "tpch", snapshot_id=sid, created=F.lit(at))
    left = B.expire(spark, root, now=F.lit(RETENTION_NOW).cast("timestamp"))
    return left.select("snapshot_id", "table", "rows")


QUERIES = {
    "snapshot_manifest": snapshot_manifest,
    "snapshot_restore": snapshot_restore,
    "snapshot_retention": snapshot_retention,
    "snapshot_diff": snapshot_diff,
    "snapshot_diff_tree": snapshot_diff_tree,
    "snapshot_expire": snapshot_expire,
}

_B = """(SELECT o_orderkey, o_orderstatus,
        CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN o_totalprice + 1
             ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders
 UNION ALL
 SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
 WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW')"""
_A = "(SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)"

ORACLE = {
    "snapshot_manifest": """
SELECT 'nation' AS "table", count(*) AS rows, true AS checksum_ok FROM nation
UNION ALL SELECT 'region', count(*), true FROM region
UNION ALL SELECT 'orders', count(*), true FROM orders""",
    "snapshot_restore": "SELECT * FROM orders",
    "snapshot_retention": f"""
SELECT * FROM (
  SELECT event_id AS snapshot_id, ts AS created,
         CAST(floor((epoch_us(TIMESTAMP '{RETENTION_NOW}') - epoch_us(ts)) / 86400000000) AS BIGINT)
           AS age_days
  FROM events) WHERE age_days > 7""",
    "snapshot_diff": f"""
SELECT *, 'left_only' AS side FROM (SELECT * FROM {_A} a EXCEPT ALL SELECT * FROM {_B} b)
UNION ALL
SELECT *, 'right_only' AS side FROM (SELECT * FROM {_B} b EXCEPT ALL SELECT * FROM {_A} a)""",
}

ORACLE["snapshot_diff_tree"] = ORACLE["snapshot_diff"]
ORACLE["snapshot_expire"] = """
SELECT s AS snapshot_id, t AS "table", n AS rows FROM (SELECT unnest(['week', 'new']) AS s),
  (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders)"""
