"""Session construction and the shared work folder.

Everything that writes (sinks, snapshots, topics, stream checkpoints) goes
below one shared folder: the one the cluster names in ``spark.checkpoint.dir``.
Only a local-mode session with no such setting (tests, the smoke driver) gets
a fresh temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session gets; sized for local tests, overridable by the
# cluster's own spark-defaults.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # A recursive CTE's output grows with its input (one row per chain
    # element); the default cap of 1M rows would fail at scale. The level
    # limit (default 100) still stops runaway recursion.
    "spark.sql.cteRecursionRowLimit": "-1",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tidepool", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:  # else the cluster's own setting holds
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


# Rows go to Python workers in batches of this size, unless the session has its own. Spark's
# 64 MB lie in the executor outside its heap, and in the worker too, once for each running task.
ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    if spark.conf.get(ARROW_BATCH[0], None) is None:
        spark.conf.set(*ARROW_BATCH)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_root(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). A local session without one gets a private temporary
    folder; a cluster session without one is an error, because a
    machine-local folder is not visible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/NFS) "
            "that every executor can reach")
    root = tempfile.mkdtemp(prefix="tidepool-")
    spark.sparkContext.setCheckpointDir(root)
    # setCheckpointDir creates a uuid sub-folder; use what the context reports.
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path below the shared folder; a fresh one per call when ``unique``."""
    segs = [shared_root(spark), "tidepool", *parts]
    if unique:
        segs.append(uuid.uuid4().hex[:12])
    return "/".join(s.strip("/") if i else s.rstrip("/") for i, s in enumerate(segs))


# Spark removes the shuffle files of a write as soon as it is done, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """The table as written to a folder: computed once, and it cuts the lineage. Of what
    the work took, nothing stays on disk but the table."""
    spark = df.sparkSession
    had = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if had is None else spark.conf.set(CLEAN, had)
    return spark.read.parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared folder that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
