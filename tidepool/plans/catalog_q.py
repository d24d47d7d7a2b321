"""Registered catalog queries.

Each call makes databases with fresh names whose data lives below the shared
work folder, fills them from the given tables, and reports on them.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import keyindex, textindex
from ..session import work_path
from ..sources.tables import load

# Lineitem columns (for the per-column NULL counts).
LINEITEM_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate")


def fresh_db(spark, tag: str, owner: str | None = None) -> str:
    name = f"tp_{uuid.uuid4().hex[:10]}_{tag}"
    C.create_db(spark, name, owner=owner, location=work_path(spark, "db", name, unique=False))
    return name


def _copy(spark, sf_dir, db, tables):
    for t in tables:
        load(spark, sf_dir, t).write.format("parquet").saveAsTable(f"{db}.{t}")


def _strip(col):
    return F.regexp_replace(col, r"^tp_[0-9a-f]+_", "")


def list_databases(spark, sf_dir):
    db = fresh_db(spark, "lake")
    _copy(spark, sf_dir, db, ["region"])
    prefix = db[: -len("lake")]
    dbs = C.list_databases(spark, f"{prefix}*").select(
        _strip(F.col("namespace")).alias("name"), F.lit(None).cast("bigint").alias("rows"))
    rows = spark.table(f"{db}.region").agg(F.count(F.lit(1)).alias("rows")) \
        .select(F.lit("lake").alias("name"), "rows")
    # listed names and counted rows, folded per database name (no join)
    return dbs.unionByName(rows).groupBy("name").agg(F.max("rows").alias("rows"))


def list_tables(spark, sf_dir):
    db = fresh_db(spark, "tables")
    names = ["nation", "region", "supplier"]
    _copy(spark, sf_dir, db, names)
    counts = None
    for t in names:
        c = spark.table(f"{db}.{t}").agg(F.count(F.lit(1)).alias("rows")) \
            .select(F.lit(t).alias("tableName"), "rows")
        counts = c if counts is None else counts.unionByName(c)
    listed = C.list_tables(spark, db).select("tableName", "isTemporary")
    return listed.join(counts, "tableName")


def create_db(spark, sf_dir):
    db = fresh_db(spark, "owned", owner="analyst")
    try:
        C.create_db(spark, db)  # a second create of the same name must fail
        rejected = False
    except AnalysisException as e:
        if e.getCondition() != "SCHEMA_ALREADY_EXISTS":
            raise
        rejected = True
    _copy(spark, sf_dir, db, ["nation"])
    props = C.db_properties(spark, db).filter(F.col("info_name") == "Properties")
    owner = props.select(F.lit("owned").alias("name"),
                         F.regexp_extract("info_value", r"db_owner,([^)]*)\)", 1).alias("owner"))
    rows = spark.table(f"{db}.nation").agg(F.count(F.lit(1)).alias("rows")) \
        .select(F.lit("owned").alias("name"), "rows")
    folded = owner.unionByName(rows, allowMissingColumns=True).groupBy("name") \
        .agg(F.max("owner").alias("owner"), F.max("rows").alias("rows"))
    return folded.select("name", "owner", F.lit(rejected).alias("dup_rejected"), "rows")


def create_drop_index(spark, sf_dir):
    """An index is made, filled and dropped; what it held is counted from it before."""
    root = work_path(spark, "indexes")
    path, counted = f"{root}/docs", work_path(spark, "index_counts")
    textindex.create(spark, path)
    textindex.append(textindex.column_documents(load(spark, sf_dir, "documents"), "doc_id", ["text", "lang"]), path)
    textindex.documents(spark, path).agg(
        F.count("*").alias("rows_indexed"), F.sum(F.length(F.get_json_object("raw", "$.text"))).alias("chars")).write.parquet(counted)
    textindex.drop(spark, path)
    left = textindex.listing(spark, root).agg((F.count("*") > 0).alias("exists_after_drop"))
    return spark.read.parquet(counted).unionByName(left, allowMissingColumns=True) \
        .agg(F.max("rows_indexed").alias("rows_indexed"), F.max("chars").alias("chars"), F.max("exists_after_drop").alias("exists_after_drop"))


def table_stats(spark, sf_dir):
    st = C.table_stats(load(spark, sf_dir, "lineitem"), "lineitem")
    return st.select("table", "rows", *[f"nulls_{c}" for c in LINEITEM_COLS],
                     (F.col("bytes") > 0).alias("has_bytes"))


def layout_lookup(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    path = work_path(spark, "layout")
    C.write_lookup_layout(li, path, "l_orderkey", then=["l_linenumber"])
    urgent = load(spark, sf_dir, "orders").filter(
        (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    return C.lookup_join(spark.read.parquet(path), urgent, "l_orderkey", "o_orderkey")


def index_lookup(spark, sf_dir):
    """The lines of the five dearest orders, from the files that may hold them."""
    path, index = work_path(spark, "lines"), work_path(spark, "key_index")
    load(spark, sf_dir, "lineitem").repartition(16, "l_orderkey").write.parquet(path)
    keyindex.build(spark, path, index, "l_orderkey")
    dearest = load(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)
    return keyindex.lookup(spark, path, index, "l_orderkey", [r[0] for r in dearest.select("o_orderkey").collect()])  # five keys


QUERIES = {
    "list_databases": list_databases,
    "list_tables": list_tables,
    "create_db": create_db,
    "create_drop_index": create_drop_index,
    "table_stats": table_stats,
    "layout_lookup": layout_lookup,
    "index_lookup": index_lookup,
}

ORACLE = {
    "list_databases": "SELECT 'lake' AS name, count(*) AS rows FROM region",
    "list_tables": """
SELECT 'nation' AS tableName, false AS isTemporary, count(*) AS rows FROM nation
UNION ALL SELECT 'region', false, count(*) FROM region
UNION ALL SELECT 'supplier', false, count(*) FROM supplier""",
    "create_db": "SELECT 'owned' AS name, 'analyst' AS owner, true AS dup_rejected, "
                 "count(*) AS rows FROM nation",
    "create_drop_index": "SELECT count(*) AS rows_indexed, sum(n_chars) AS chars, "
                         "false AS exists_after_drop FROM documents",
    "table_stats": "SELECT 'lineitem' AS \"table\", count(*) AS rows, "
                   + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS nulls_{c}"
                               for c in LINEITEM_COLS)
                   + ", true AS has_bytes FROM lineitem",
    "index_lookup": "SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders "
                    "ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)",
    "layout_lookup": "SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders "
                     "WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
}
