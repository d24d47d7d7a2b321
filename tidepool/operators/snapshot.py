"""Verified snapshots: backup (B01), restore (B02), retention (B03), diff.

Layout below a snapshot root (a shared folder)::

    <root>/<snapshot_id>/<table>/part-*.parquet    data, one folder per table
    <root>/_manifest/part-*.parquet                one row per (snapshot, table)

The manifest row carries rows, the schema as JSON and an order-insensitive
checksum: the sum over rows of a 64-bit row hash, as DECIMAL(38,0) so it
cannot overflow. It is computed from the *written* copy, so a manifest row
vouches for what is on storage, and it is one partial aggregate per task,
one merge - no row reaches the driver.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Snapshot id time format, retention rule (older than 7 whole days).
SNAPSHOT_TS_FMT = "%Y%m%d-%H%M%S"
RETENTION_DAYS = 7
_MICROS_PER_DAY = 86_400_000_000


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row; NULL flags are hashed too, so (NULL, 1)
    and (1, NULL) differ."""
    parts = []
    for c in df.columns:
        parts += [F.col(c), F.col(c).isNull()]
    return F.xxhash64(*parts)


def checksum(df: DataFrame) -> Column:
    """Aggregate: multiset checksum, equal for equal multisets of rows."""
    return F.coalesce(F.sum(row_hash(df).cast("decimal(38,0)")),
                      F.lit(0).cast("decimal(38,0)"))


def new_snapshot_id(now: _dt.datetime | None = None) -> str:
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return f"{now.strftime(SNAPSHOT_TS_FMT)}-{uuid.uuid4().hex[:6]}"


def backup(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, db: str,
           snapshot_id: str | None = None, compression: str = "snappy", created: Column | None = None) -> str:
    """Write every table of ``tables`` and append its manifest row (with the time
    ``created``, now where left out); return the id."""
    sid = snapshot_id or new_snapshot_id()
    root = root.rstrip("/")
    for name, df in tables.items():
        path = f"{root}/{sid}/{name}"
        df.write.mode("error").option("compression", compression).parquet(path)
        written = spark.read.parquet(path)
        manifest = written.agg(F.count(F.lit(1)).alias("rows"), checksum(written).alias("checksum"))
        (manifest.select(F.lit(sid).alias("snapshot_id"),
                         (F.current_timestamp() if created is None else created.cast("timestamp")).alias("created"),
                         F.lit(db).alias("db"), F.lit(name).alias("table"),
                         "rows", F.lit(written.schema.json()).alias("schema_json"), "checksum")
         .write.mode("append").parquet(f"{root}/_manifest"))
    return sid


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The snapshots that are there: those marked for deletion are not among them."""
    rows, gone = spark.read.parquet(f"{root.rstrip('/')}/_manifest"), _retired(spark, root)
    return rows if gone is None else rows.join(gone.select("snapshot_id").distinct(), "snapshot_id", "left_anti")


_RETIRED = "snapshot_id string, state string, at timestamp"


def _retired(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.schema(_RETIRED).parquet(f"{root.rstrip('/')}/_retired")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def expire(spark: SparkSession, root: str, now: Column | None = None, days: int = RETENTION_DAYS) -> DataFrame:
    """Delete the snapshots that ``expired`` names; the manifest of those left.

    Two steps: they are marked (from then on no reader sees them), then their
    folders are deleted and that is noted. A run that stopped between the two, or in the
    middle of the second, is finished by the next one."""
    root = root.rstrip("/")

    def note(rows: DataFrame, state: str) -> None:
        rows.select("snapshot_id", F.lit(state).alias("state"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{root}/_retired")

    due = expired(manifest(spark, root), now, days).select("snapshot_id").distinct()
    if due.limit(1).count():
        note(due, "marked")
    gone = _retired(spark, root)
    if gone is not None:
        left = gone.groupBy("snapshot_id").agg(F.max(F.col("state") == "deleted").alias("deleted")).filter("NOT deleted").select("snapshot_id")
        for r in left.toLocalIterator():  # a folder each, deleted by the file system
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{r['snapshot_id']}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            note(spark.createDataFrame([(r["snapshot_id"],)], "snapshot_id string"), "deleted")
    return manifest(spark, root)


# --- B04: diff by a checksum tree ------------------------------------------------

BUCKETS, LEAVES = 64, 64  # folders of a tree, and leaves in each


def write_tree(df: DataFrame, path: str) -> None:
    """Write ``df`` in folders by its row hash, with a multiset checksum for each folder and leaf.

    A folder's rows are spread over several tasks, so that a row that repeats very often is no hot key."""
    h = row_hash(df)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(8))
    df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), h.alias("hash"),
              F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"), F.pmod(F.shiftright(h, 20), F.lit(LEAVES)).cast("int").alias("leaf")) \
        .repartition("bucket", salt).write.partitionBy("bucket").parquet(f"{path}/rows")
    df.sparkSession.read.parquet(f"{path}/rows").groupBy("bucket", "leaf") \
        .agg(F.count("*").alias("n"), F.sum(F.col("hash").cast("decimal(38,0)")).alias("checksum")).write.parquet(f"{path}/tree")


def unequal(spark: SparkSession, path_a: str, path_b: str) -> DataFrame:
    """(bucket, leaf) whose rows differ, from the two small tables of checksums alone."""
    side = lambda p, name: spark.read.parquet(f"{p}/tree").select("bucket", "leaf", F.struct("n", "checksum").alias(name))
    return side(path_a, "a").join(side(path_b, "b"), ["bucket", "leaf"], "full").filter("NOT a <=> b").select("bucket", "leaf")


def diff_tree(spark: SparkSession, path_a: str, path_b: str) -> DataFrame:
    """As ``diff``, of two trees with the same columns: only the folders that hold an unequal leaf are read."""
    leaves = unequal(spark, path_a, path_b)
    buckets = sorted(r[0] for r in leaves.select("bucket").distinct().collect())  # at most BUCKETS numbers

    def rows(path: str) -> DataFrame:
        all_ = spark.read.parquet(f"{path}/rows")
        return all_.filter(F.col("bucket").isin(buckets)).join(F.broadcast(leaves), ["bucket", "leaf"], "left_semi").select("row.*")

    return diff(rows(path_a), rows(path_b))


def restore(spark: SparkSession, root: str, snapshot_id: str, target_db: str,
            tables: list[str] | None = None, mode: str = "error",
            verify: bool = True) -> dict[str, DataFrame]:
    """Copy a snapshot's tables into ``target_db`` (any name, not only the
    original). Fails if a table exists unless ``mode`` says otherwise.

    With ``verify`` the rows and checksum of the snapshot data are checked
    against the manifest before anything is written.
    """
    root = root.rstrip("/")
    m = manifest(spark, root).filter(F.col("snapshot_id") == snapshot_id)
    # the table list of one snapshot: metadata, one row per table
    names = [r["table"] for r in m.select("table").collect()]
    if tables is not None:
        absent = sorted(set(tables) - set(names))
        if absent:
            raise ValueError(f"snapshot {snapshot_id!r} has no tables {absent}")
        names = [t for t in names if t in set(tables)]
    if not names:
        raise ValueError(f"snapshot {snapshot_id!r} has no such tables")
    out, read = {}, {}
    for name in names:  # all are verified before any is written
        data = read[name] = spark.read.parquet(f"{root}/{snapshot_id}/{name}")
        if verify:
            found = (data.agg(F.count(F.lit(1)).alias("rows"), checksum(data).alias("checksum"))
                     .select(F.lit(name).alias("table"), "rows", "checksum"))
            ok = (found.join(m.select("table", "rows", "checksum"), ["table", "rows", "checksum"])
                  .count())
            if ok != 1:
                raise ValueError(f"snapshot {snapshot_id}/{name} does not match its manifest")
    for name, data in read.items():
        data.write.mode(mode).format("parquet").saveAsTable(f"{target_db}.{name}")
        out[name] = spark.table(f"{target_db}.{name}")
    return out


def age_days(created: Column, now: Column) -> Column:
    """Whole days between ``created`` and ``now``, truncated like ``find -mtime``."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))
    return F.floor(micros / F.lit(_MICROS_PER_DAY)).cast("bigint")


def expired(manifest_df: DataFrame, now: Column | None = None, days: int = RETENTION_DAYS,
            created: str = "created") -> DataFrame:
    """Snapshots ``find -mtime +days`` would delete: whole-day age > ``days``.

    Returns the rows; ``expire`` deletes them.
    """
    now = now if now is not None else F.current_timestamp()
    return (manifest_df.withColumn("age_days", age_days(F.col(created), now))
            .filter(F.col("age_days") > F.lit(days)))


_RUN = 65_536  # longest list of repeats of one row in ``diff``


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one side and not the other, as multisets, with a ``side`` column.

    Empty result = equal tables. One shuffle on the whole row: both sides are
    counted together, plus one and minus one, and the sign gives the side. A row
    that is over several times is given as often, from lists of bounded length.
    Compare ``checksum`` first when only a yes/no is needed.
    """
    cols = a.columns
    n, runs = (next(c for c in (p + "_" * i for i in range(len(cols) + 1)) if c not in cols) for p in ("n", "runs"))
    keys = [F.col(f"`{c}`") for c in cols]
    both = a.select(*keys, F.lit(1).cast("bigint").alias(n)) \
        .union(b.toDF(*cols).select(*keys, F.lit(-1).cast("bigint").alias(n)))
    over = both.groupBy(*keys).agg(F.sum(n).alias(n)).filter(F.col(n) != 0)
    times, run = F.abs(n), F.lit(_RUN).cast("bigint")
    starts = over.withColumn(runs, F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1, run)))
    each = F.array_repeat(F.lit(True), F.least(run, times - F.col(runs)).cast("int"))
    return starts.withColumn(runs, F.explode(each)).select(
        *keys, F.when(F.col(n) > 0, "left_only").otherwise("right_only").alias("side"))


def same_checksum(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows and checksums of both sides and whether they agree."""
    sa = a.agg(F.count(F.lit(1)).alias("rows_a"), checksum(a).alias("sum_a"))
    sb = b.agg(F.count(F.lit(1)).alias("rows_b"), checksum(b).alias("sum_b"))
    both = sa.unionByName(sb, allowMissingColumns=True)  # two rows, folded into one
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn(
        "equal", (F.col("rows_a") == F.col("rows_b")) & (F.col("sum_a") == F.col("sum_b")))
