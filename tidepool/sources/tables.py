"""The given tables: one Parquet dataset per name below a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temp views named like the tables, so SQL text can refer to them.

    Views are plans, not copies: nothing is read until a query runs.
    """
    for name in names:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
