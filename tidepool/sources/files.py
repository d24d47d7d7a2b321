"""Object-store / file scans and writes (S04), path-agnostic.

The same code reads ``s3a://``, ``hdfs://``, ``abfss://`` or local paths; the
filesystem connector comes with the cluster. Filters and the column list go
into the plan before any action, so Parquet scans show them as
``PushedFilters`` and a pruned ``ReadSchema``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from .jsonio import _JSON_OPTS


def scan(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet",
         schema: StructType | str | None = None, columns: Sequence[str | Column] | None = None,
         where: Column | str | None = None, **options) -> DataFrame:
    """Read files lazily, then filter and project (pushed into the scan)."""
    r = spark.read.format(fmt)
    if fmt == "json":
        r = r.options(**_JSON_OPTS)
    if fmt == "csv":
        r = r.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    if options:
        r = r.options(**options)
    df = r.load(path if isinstance(path, str) else list(path))
    if where is not None:
        df = df.filter(where)
    if columns is not None:
        df = df.select(*columns)
    return df


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error",
          partition_by: Sequence[str] = (), **options) -> str:
    """Write ``df`` in parallel, one file per task (and per partition value)."""
    w = df.write.format(fmt).mode(mode)
    if fmt == "json":
        w = w.options(**_JSON_OPTS)
    if fmt == "csv":
        w = w.option("header", True)
    if options:
        w = w.options(**options)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path
