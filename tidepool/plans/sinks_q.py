"""Registered source/sink round trips.

Each sink writes below the shared work folder and returns the data read
back, so the oracle is the source table itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import work_path
from ..sources import files, jsonio
from ..sources.tables import load, table_path
from .catalog_q import fresh_db


def import_json(spark, sf_dir):
    cust = load(spark, sf_dir, "customer")
    src = work_path(spark, "import_src")
    jsonio.export_json(cust, src, array=True)  # one JSON array per part file
    db = fresh_db(spark, "imp")
    return jsonio.import_json(spark, src, f"{db}.customers", schema=cust.schema, array=True)


def import_json_large(spark, sf_dir):
    """One file that holds one array, read in many ranges."""
    cust = load(spark, sf_dir, "customer")
    src = work_path(spark, "import_one")
    jsonio.export_json(cust.coalesce(1), src, array=True)
    db = fresh_db(spark, "one")
    return jsonio.import_json(spark, src, f"{db}.customers", schema=cust.schema, array=True)


def export_json(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    out = work_path(spark, "export", jsonio.default_export_name("events"))
    jsonio.export_json(ev, out)
    return jsonio.read_json(spark, out, schema=ev.schema)


def scan_parquet(spark, sf_dir):
    return files.scan(spark, table_path(sf_dir, "lineitem"),
                      columns=["l_orderkey", "l_partkey", "l_quantity", "l_shipdate"],
                      where=(F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))


def index_docs(spark, sf_dir):
    ev = load(spark, sf_dir, "events")
    docs = ev.select("event_id", F.to_json(F.struct(
        F.col("event_type").alias("message"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("value").alias("value"))).alias("j"))
    path = work_path(spark, "index")
    jsonio.index_docs(docs, "j", path, id_col="event_id")
    idx = spark.read.parquet(path)
    return idx.select(F.col("_id").cast("bigint").alias("event_id"),
                      jsonio.doc_field("doc", "$.message", "string").alias("message"),
                      jsonio.doc_field("doc", "$.timestamp", "string").alias("timestamp"),
                      jsonio.doc_field("doc", "$.value", "double").alias("value"))


def insert_docs(spark, sf_dir):
    cust = load(spark, sf_dir, "customer")
    path = work_path(spark, "collection")
    jsonio.insert_docs(cust.filter(F.col("c_mktsegment") == "BUILDING")
                       .select("c_custkey", "c_name", "c_acctbal"), path)
    jsonio.insert_docs(cust.filter(F.col("c_mktsegment") != "BUILDING")
                       .select("c_custkey", "c_name", "c_mktsegment"), path)
    return jsonio.read_docs(spark, path).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def insert_mixed(spark, sf_dir):
    """A field that is a number, a text or an object, by the kind of event."""
    ev, path = load(spark, sf_dir, "events"), work_path(spark, "mixed")
    by_kind = {0: F.col("user_id"), 1: F.concat(F.lit("u"), "user_id"), 2: F.struct(F.col("user_id").alias("id"), F.lit(True).alias("known"))}
    for part, who in by_kind.items():
        one = ev.filter(F.pmod("event_id", F.lit(3)) == part)
        jsonio.insert_mixed(one.select(F.to_json(F.struct("event_id", who.alias("who"))).alias("j")), "j", path)
    docs = spark.read.parquet(path)
    return docs.select(jsonio.mixed_field("$.event_id", "bigint").alias("event_id"), jsonio.mixed_field("$.who", "bigint").alias("number"),
                       jsonio.mixed_field("$.who", "string").alias("text"), jsonio.mixed_field("$.who.id", "bigint").alias("inner_id"))


QUERIES = {
    "import_json": import_json,
    "import_json_large": import_json_large,
    "export_json": export_json,
    "scan_parquet": scan_parquet,
    "index_docs": index_docs,
    "insert_docs": insert_docs,
    "insert_mixed": insert_mixed,
}

ORACLE = {
    "import_json": "SELECT * FROM customer",
    "import_json_large": "SELECT * FROM customer",
    "export_json": "SELECT * FROM events",
    "scan_parquet": "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem "
                    "WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "index_docs": "SELECT event_id, event_type AS message, "
                  "strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, value FROM events",
    "insert_mixed": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS number, "
                    "CASE WHEN event_id % 3 = 1 THEN 'u' || user_id END AS text, "
                    "CASE WHEN event_id % 3 = 2 THEN user_id END AS inner_id FROM events",
    "insert_docs": "SELECT c_custkey, c_name, "
                   "CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS c_acctbal, "
                   "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment "
                   "FROM customer",
}
