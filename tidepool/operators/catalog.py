"""Catalog and table management.

Databases and tables live in the session's catalog; their data goes below a
location the caller gives (the shared folder on a cluster). Statistics are
aggregates over the data and the scan's file metadata, never a listing
pulled to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def _ident(name: str) -> str:
    """Validate an identifier and quote it: user text never goes into DDL raw."""
    if not _IDENT.match(name):
        raise ValueError(f"not a plain identifier: {name!r}")
    return f"`{name}`"


def _str_lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def list_databases(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """``\\l`` / ``show dbs``: one row per database (``namespace``)."""
    q = "SHOW DATABASES" + (f" LIKE {_str_lit(pattern)}" if pattern else "")
    return spark.sql(q)


def list_tables(spark: SparkSession, db: str = "default", include_temp: bool = False) -> DataFrame:
    """``\\dt`` / ``show collections`` / index and topic lists of one database.

    ``SHOW TABLES`` also lists the session's temporary views whatever the
    database; they are left out unless ``include_temp``.
    """
    out = spark.sql(f"SHOW TABLES IN {_ident(db)}")
    return out if include_temp else out.filter(~F.col("isTemporary"))


def create_db(spark: SparkSession, name: str, owner: str | None = None,
              location: str | None = None, if_not_exists: bool = False) -> None:
    """``CREATE DATABASE name [OWNER o]``: an error if it exists, unless asked.

    The owner is kept as a database property (Spark has no accounts).
    """
    q = "CREATE DATABASE " + ("IF NOT EXISTS " if if_not_exists else "") + _ident(name)
    if location:
        q += f" LOCATION {_str_lit(location)}"
    if owner:
        q += f" WITH DBPROPERTIES ('db_owner' = {_str_lit(owner)})"
    spark.sql(q)


ABOUT = "_about"


def describe_db(spark: SparkSession, name: str, owner: str | None, location: str) -> None:
    """Write beside a database's tables what ``attach`` needs to know of it."""
    spark.createDataFrame([(name, owner)], "name string, owner string").coalesce(1).write.mode("overwrite").json(f"{location}/{ABOUT}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    return [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and not s.getPath().getName().startswith("_temporary")]


def attach(spark: SparkSession, root: str) -> list[str]:
    """Name the databases below ``root``, and their Parquet tables, in this session's catalog:
    what one command made, the next one finds, whatever the catalog behind the session."""
    there = {r["namespace"] for r in list_databases(spark).collect()}  # names only
    found = _folders(spark, root)
    for name in found:
        location = f"{root}/{name}"
        inside = _folders(spark, location)
        if name not in there:
            owner = spark.read.schema("name string, owner string").json(f"{location}/{ABOUT}").first() if ABOUT in inside else None
            create_db(spark, name, owner=owner and owner["owner"], location=location, if_not_exists=True)
        known = {r["tableName"] for r in list_tables(spark, name).collect()}
        for table in (t for t in inside if t != ABOUT and t.lower() not in known):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {_ident(name)}.{_ident(table)} USING parquet LOCATION {_str_lit(f'{location}/{table}')}")
    return found


def db_properties(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE DATABASE EXTENDED {_ident(name)}")


def create_index(spark: SparkSession, table: str, schema: str, key: str,
                 shards: int = 1, location: str | None = None) -> None:
    """An index = a table bucketed by its key; one shard = one bucket.

    ``table`` is ``db.name``; ``schema`` a DDL column list.
    """
    db, _, name = table.rpartition(".")
    full = (f"{_ident(db)}." if db else "") + _ident(name)
    q = (f"CREATE TABLE {full} ({schema}) USING parquet "
         f"CLUSTERED BY ({_ident(key)}) SORTED BY ({_ident(key)}) INTO {int(shards)} BUCKETS")
    if location:
        q += f" LOCATION {_str_lit(location)}"
    spark.sql(q)


def drop_index(spark: SparkSession, table: str) -> None:
    """Delete an index; the name is required, as in the reference command."""
    if not table:
        raise ValueError("index name required")
    db, _, name = table.rpartition(".")
    spark.sql("DROP TABLE " + (f"{_ident(db)}." if db else "") + _ident(name))


def table_stats(df: DataFrame, name: str | None = None) -> DataFrame:
    """Rows, stored bytes, average row size and NULLs per column, in one pass.

    Bytes are the sizes of the distinct files the scan reads (from the
    ``_metadata`` column of a file source); a frame not read from files gets
    NULL bytes.
    """
    cols = [c for c in df.columns]
    has_meta = True
    try:
        df.select("_metadata.file_path")
    except AnalysisException:  # not a file scan
        has_meta = False
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in cols]
    stats = df.agg(*aggs)
    if has_meta:
        # one row of file bytes next to the one row of counts: union the two
        # and fold them with one aggregate (each column is set in one row)
        files = (df.select("_metadata.file_path", "_metadata.file_size").distinct()
                 .agg(F.sum("file_size").alias("bytes")))
        both = stats.unionByName(files, allowMissingColumns=True)
        stats = both.agg(*[F.max(c).alias(c) for c in both.columns])
    else:
        stats = stats.withColumn("bytes", F.lit(None).cast("bigint"))
    stats = stats.withColumn(
        "avg_row_bytes",
        F.when(F.col("rows") > 0, F.col("bytes") / F.col("rows")))
    if name is not None:
        stats = stats.select(F.lit(name).alias("table"), "*")
    return stats


# --- C06: layout for fast equality lookups ------------------------------------

def write_lookup_layout(df: DataFrame, path: str, key: str, then: Sequence[str] = (),
                        files: int | None = None, bloom_filter: bool = True) -> None:
    """Range-partition and sort by ``key`` so each file holds one key range.

    Parquet row-group min/max statistics then let an equality filter on
    ``key`` skip every file and row group that cannot hold the value: the
    file-store equivalent of a secondary index. ``repartitionByRange``
    samples the key to pick boundaries. Equal keys share a file unless ``then``
    names further columns: name enough of them to tell a hot key's rows apart
    and its rows are split over several files. Without ``files`` the number of
    files follows the data (the session's shuffle partitions, coalesced). With ``bloom_filter``
    each row group also carries a Parquet bloom filter on ``key``, so a
    lookup skips row groups whose range holds the value but whose keys do not.
    """
    by = [F.col(c) for c in (key, *then)]
    dealt = df.repartitionByRange(*by) if files is None else df.repartitionByRange(files, *by)
    w = (dealt.sortWithinPartitions(*by)
         .write.mode("overwrite"))
    if bloom_filter:
        w = w.option(f"parquet.bloom.filter.enabled#{key}", "true")
    w.parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int,
                   location: str | None = None) -> None:
    """A catalog table bucketed and sorted by ``key``: joins and lookups on
    ``key`` against another table bucketed the same way need no shuffle."""
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if location:
        w = w.option("path", location)
    w.saveAsTable(table)


def lookup(df: DataFrame, key: str, values: Sequence) -> DataFrame:
    """Equality lookup of a few literal values (pushed into the scan)."""
    return df.filter(F.col(key).isin(list(values)))


def lookup_join(df: DataFrame, keys: DataFrame, key: str, keys_col: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among the keys of another frame.

    A left-semi join: AQE broadcasts the key side when its runtime size is
    small and falls back to a shuffled join when it is not. Every file of
    ``df`` is read: keys from another frame are not pushed into the scan; for a
    few known values use ``lookup``, which is.
    """
    kc = keys_col or key
    return df.join(keys.select(F.col(kc).alias(key)).distinct(), key, "left_semi")
