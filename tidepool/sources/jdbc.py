"""Relational source and sink over JDBC.

Reads are split into ``num_partitions`` range queries on a numeric, date or
timestamp column, so the database is read by many tasks at once; filters
and the column list Spark pushes into the generated ``SELECT``. Writes go
out from ``num_partitions`` tasks in batches.

The driver jar of the target database must be on the cluster's classpath.
No database server runs in this repository's tests, so these two functions
have no registered query; see the README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def connection_url(host: str, port: int, db: str, kind: str = "postgresql") -> str:
    """``jdbc:<kind>://host:port/db``; credentials go in ``props``, never the URL."""
    return f"jdbc:{kind}://{host}:{int(port)}/{db}"


def read_table(spark: SparkSession, url: str, table: str, props: dict | None = None,
               partition_column: str | None = None, lower: int | str | None = None,
               upper: int | str | None = None, num_partitions: int = 8,
               fetch_size: int = 10_000) -> DataFrame:
    r = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
         .option("fetchsize", fetch_size).option("pushDownPredicate", True))
    if partition_column is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper bounds")
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    for k, v in (props or {}).items():
        r = r.option(k, v)
    return r.load()


def write_table(df: DataFrame, url: str, table: str, props: dict | None = None,
                mode: str = "append", num_partitions: int = 8, batch_size: int = 10_000) -> None:
    w = (df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
         .option("numPartitions", num_partitions).option("batchsize", batch_size))
    for k, v in (props or {}).items():
        w = w.option(k, v)
    w.save()
