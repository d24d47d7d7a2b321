"""Federated SQL (Q11): one SQL statement over tables from different sources.

Each source becomes a temporary view over its own reader (Parquet or JSON
files on an object store, a JDBC table, a catalog table). Spark plans the
statement as a whole: filters and projections go down into every scan that
accepts them (Parquet/JSON pushed filters, JDBC ``WHERE``), the join
strategy is chosen from the sizes AQE sees at run time.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources import files, jdbc


@dataclass
class Source:
    kind: str                      # parquet | json | csv | jdbc | table
    path: str = ""                 # file path, JDBC URL or catalog table name
    table: str = ""                # JDBC table
    schema: object = None
    options: dict = field(default_factory=dict)


def open_source(spark: SparkSession, src: Source) -> DataFrame:
    if src.kind == "jdbc":
        return jdbc.read_table(spark, src.path, src.table, **src.options)
    if src.kind == "table":
        return spark.table(src.path)
    return files.scan(spark, src.path, fmt=src.kind, schema=src.schema, **src.options)


def federated_sql(spark: SparkSession, sources: Mapping[str, Source], query: str) -> DataFrame:
    """Register every source under its name, then run ``query`` over them."""
    for name, src in sources.items():
        open_source(spark, src).createOrReplaceTempView(name)
    return spark.sql(query)
