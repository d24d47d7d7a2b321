"""Command line: the platform's everyday data commands on Spark.

    python -m tidepool [--root DIR] [--tables SF_DIR] <command> ...

Commands mirror the usual service commands: ``sql``, ``list-db``,
``list-tables``, ``create-db``, ``import``, ``export``, ``backup``,
``restore``, ``expired``, ``expire``, ``search``, ``index``, ``tail``, ``follow``,
``stats``, ``pi``. Each builds its plan from the
operators in this package; printing shows all rows, or at most ``--rows``, the
only data that reaches the driver.

``--root`` is where indexes, snapshots and databases live; it defaults to
the session's ``spark.checkpoint.dir``. Databases outlive a command: each
command finds those that earlier ones made below it.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import catalog, docquery, jobs, search, snapshot, textindex
from .operators.sqlpass import run_sql
from .session import build_session, shared_root
from .sources import jsonio, logs
from .sources.tables import TABLES, register_views
from .streaming import appended


def _show(df: DataFrame, rows: int) -> None:
    rows = rows or df.count()  # 0: all
    df.show(rows, truncate=False)


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="tidepool")
    ap.add_argument("--master", default=None)
    ap.add_argument("--root", default=None, help="shared folder (default spark.checkpoint.dir)")
    ap.add_argument("--tables", default=None, help="folder of <table>.parquet to expose as views")
    ap.add_argument("--rows", type=int, default=0)
    sub = ap.add_subparsers(dest="cmd", required=True)

    p = sub.add_parser("sql"); p.add_argument("query"); p.add_argument("db", nargs="?")
    sub.add_parser("list-db")
    p = sub.add_parser("list-tables"); p.add_argument("db", nargs="?", default="default")
    p = sub.add_parser("create-db"); p.add_argument("name"); p.add_argument("owner", nargs="?")
    p = sub.add_parser("import"); p.add_argument("path"); p.add_argument("db"); p.add_argument("coll")
    p.add_argument("--array", action="store_true")
    p = sub.add_parser("export"); p.add_argument("db"); p.add_argument("coll")
    p.add_argument("path", nargs="?"); p.add_argument("--array", action="store_true")
    p = sub.add_parser("backup"); p.add_argument("db", nargs="?", default="default")
    p = sub.add_parser("restore"); p.add_argument("snapshot_id"); p.add_argument("db")
    p = sub.add_parser("expired"); p.add_argument("--days", type=int, default=snapshot.RETENTION_DAYS)
    p = sub.add_parser("search"); p.add_argument("table"); p.add_argument("text", nargs="?", default="*")
    p.add_argument("--field", default="text"); p.add_argument("--id", default="doc_id")
    p.add_argument("--from", dest="start", type=int, default=None)
    p.add_argument("--size", type=int, default=None)
    p = sub.add_parser("expire"); p.add_argument("--days", type=int, default=snapshot.RETENTION_DAYS)
    p = sub.add_parser("index")
    p.add_argument("action", choices=["create", "drop", "add", "delete", "search", "count", "compact", "list"])
    p.add_argument("name", nargs="?"); p.add_argument("value", nargs="?")
    p.add_argument("--field", default="message"); p.add_argument("--size", type=int, default=10)
    p = sub.add_parser("follow"); p.add_argument("path"); p.add_argument("--seconds", type=int, default=None)
    p = sub.add_parser("tail"); p.add_argument("path"); p.add_argument("lines", nargs="?", type=int,
                                                                      default=logs.DEFAULT_TAIL)
    p = sub.add_parser("stats"); p.add_argument("table")
    p = sub.add_parser("pi"); p.add_argument("slices", nargs="?", type=int, default=jobs.DEFAULT_SLICES)
    return ap


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = build_session(a.master, app_name=f"tidepool-{a.cmd}")
    root = (a.root or shared_root(spark)).rstrip("/")
    if a.tables:
        register_views(spark, a.tables, TABLES)
    catalog.attach(spark, f"{root}/db")
    n = a.rows

    if a.cmd == "sql":
        _show(run_sql(spark, a.query, db=a.db), n)
    elif a.cmd == "list-db":
        _show(catalog.list_databases(spark), n)
    elif a.cmd == "list-tables":
        _show(catalog.list_tables(spark, a.db), n)
    elif a.cmd == "create-db":
        catalog.create_db(spark, a.name, owner=a.owner, location=f"{root}/db/{a.name}")
        catalog.describe_db(spark, a.name, a.owner, f"{root}/db/{a.name}")
    elif a.cmd == "import":
        _show(docquery.count_docs(jsonio.import_json(spark, a.path, f"{a.db}.{a.coll}", array=a.array)), n)
    elif a.cmd == "export":
        out = a.path or f"{root}/export/{jsonio.default_export_name(a.coll)}"
        jsonio.export_json(spark.table(f"{a.db}.{a.coll}"), out, array=a.array)
        print(out)
    elif a.cmd == "backup":
        names = [r["tableName"] for r in catalog.list_tables(spark, a.db)
                 .filter(~F.col("isTemporary")).collect()]  # table names only
        sid = snapshot.backup(spark, {t: spark.table(f"{a.db}.{t}") for t in names},
                              f"{root}/snapshots", db=a.db)
        print(sid)
    elif a.cmd == "restore":
        for t in snapshot.restore(spark, f"{root}/snapshots", a.snapshot_id, a.db):
            print(t)
    elif a.cmd == "expired":
        _show(snapshot.expired(snapshot.manifest(spark, f"{root}/snapshots"), days=a.days), n)
    elif a.cmd == "search":
        docs = spark.table(a.table)
        if a.start is not None or a.size is not None:
            _show(search.match_paged(docs, a.text, start=a.start or 0, size=a.size or 20,
                                     id_col=a.id), n)
        else:
            _show(search.match(docs, a.text, field=a.field, id_col=a.id), n)
    elif a.cmd == "expire":
        _show(snapshot.expire(spark, f"{root}/snapshots", days=a.days).select("snapshot_id", "table", "rows"), n)
    elif a.cmd == "index":
        path = f"{root}/indexes/{a.name}"
        if a.action == "create":
            textindex.create(spark, path)
        elif a.action == "drop":
            textindex.drop(spark, path)
        elif a.action == "add":  # one document, the default one when none is given; makes the index
            if not textindex.exists(spark, path):
                textindex.create(spark, path)
            docs = (spark.createDataFrame([(a.value,)], "json string") if a.value
                    else jsonio.default_doc(spark))
            textindex.append(textindex.json_documents(docs, "json"), path)
        elif a.action == "delete":
            print(textindex.delete(spark, path, spark.createDataFrame([(a.value,)], "_id string")))
        elif a.action == "search":
            found = textindex.search(spark, path, a.value or "*", field=a.field, k=a.size)
            _show(found.join(textindex.documents(spark, path), "_id").orderBy(F.desc("score"), "_id"), n)
        elif a.action == "compact":
            textindex.compact(spark, path)
        elif a.action == "list":
            _show(textindex.listing(spark, f"{root}/indexes"), n)
        else:
            _show(docquery.count_docs(textindex.documents(spark, path)), n)
    elif a.cmd == "follow":  # until stopped, or for some seconds
        lines = appended.follow(spark, a.path).select("value")
        q = lines.writeStream.foreachBatch(lambda b, _: [print(r["value"], flush=True) for r in b.toLocalIterator()]).start()
        if a.seconds is None:
            q.awaitTermination()
        else:
            q.awaitTermination(a.seconds)
            q.stop()
    elif a.cmd == "tail":
        lines = spark.read.text(a.path).select(
            F.col("_metadata.file_modification_time").alias("ts"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), "value") \
            .withColumn("seq", F.struct("file", "start", "place"))  # files of one time by name, then by the place in the file
        _show(logs.tail(lines, "ts", "seq", a.lines).select("value"), a.lines)
    elif a.cmd == "stats":
        _show(catalog.table_stats(spark.table(a.table), a.table), n)
    elif a.cmd == "pi":
        _show(jobs.pi_estimate(spark, slices=a.slices), n)
    return 0


if __name__ == "__main__":
    sys.exit(main())
