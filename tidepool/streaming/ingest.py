"""Structured Streaming jobs: JSON text -> object store ingest (S08) and log
follow (S12).

Follows are ``readStream`` -> built-in transformations -> ``writeStream`` to a
file sink with a checkpoint in the shared folder; the ingest writes two
sinks per batch. The file sink commits each
micro-batch through its metadata log, so re-running from the same
checkpoint neither loses nor repeats rows. ``available_now`` processes what
is there and stops (a batch-style run); otherwise the query keeps running
on a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType


def split_values(lines: DataFrame, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON text in ``value``: typed columns, and (value) of what does not parse."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    bad = "_bad" + "_" * sum(f.name.startswith("_bad") for f in kind.fields)
    told = StructType([*kind.fields, StructField(bad, StringType())])
    parsed = lines.select("value", F.from_json("value", told, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("_v"))
    good = F.col("_v").isNotNull() & F.col(f"_v.{bad}").isNull()
    return (parsed.filter(good).select(*[F.col("_v").getField(f.name).alias(f.name) for f in kind.fields]),
            parsed.filter(~good).select("value"))


def ingest_with_rejects(stream: DataFrame, schema: StructType | str, sink: str, checkpoint: str, available_now: bool = True,
                        interval: str = "10 seconds") -> StreamingQuery:
    """Text lines -> ``<sink>/rows`` and, for those that are no such JSON, ``<sink>/rejects``.

    Every micro-batch writes a folder of its own in both, named by the batch id
    and overwritten when the batch is run again: a batch that failed between
    the two writes is repeated whole and adds nothing twice. Read them with ``ingested``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        for rows, name in zip(split_values(batch, schema), ("rows", "rejects")):
            rows.write.mode("overwrite").parquet(f"{sink}/{name}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()
    if available_now:
        q.awaitTermination()
    return q


def ingested(spark: SparkSession, sink: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) that ``ingest_with_rejects`` has written."""
    read = lambda name, kind: spark.read.schema(kind).option("recursiveFileLookup", True).parquet(f"{sink}/{name}")
    return read("rows", schema), read("rejects", "value string")


def write_stream(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                 available_now: bool = True, interval: str = "10 seconds",
                 partition_by: Sequence[str] = (), name: str | None = None) -> StreamingQuery:
    w = (df.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", sink))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if name:
        w = w.queryName(name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def ingest(stream: DataFrame, sink: str, checkpoint: str, **kw) -> StreamingQuery:
    """Run an ingest to completion when ``available_now`` (the default)."""
    q = write_stream(stream, sink, checkpoint, **kw)
    if kw.get("available_now", True):
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return q


def follow_text(spark: SparkSession, log_dir: str, max_files_per_trigger: int | None = None
                ) -> DataFrame:
    """``logs N true``: every new line of every new file in ``log_dir``."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(log_dir)
