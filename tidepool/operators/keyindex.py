"""File-level key index: which files may hold a key.

The index of a Parquet folder is a small table beside it, one row per file:
path, size, smallest and largest key, and a bloom filter of its keys (bits in
64-bit slots). A lookup reads the index first and opens only the files whose
range and filter allow a key; the files need no order.

The filter has ``bits_per_key`` bits for each row of the fullest file, so false
positives stay at a few per cent whatever the files' sizes. The index knows the
size of every file: one that was added or rewritten since the build, and is not in the index
as it is now, is always opened, so a stale index costs time, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HASHES = 3


def _places(key: Column, slots: Column) -> list[Column]:
    """The filter's bit numbers of a key, by double hashing."""
    one, two = F.xxhash64(key), F.xxhash64(key, F.lit("second"))
    return [F.pmod(F.shiftright(one, 2) + F.lit(i) * F.shiftright(two, 8), slots * 64) for i in range(HASHES)]


def build(spark: SparkSession, path: str, index_path: str, key: str, bits_per_key: int = 10) -> None:
    """Write the index of the Parquet files below ``path``: one aggregation over the key column."""
    rows = spark.read.parquet(path).select(F.col(f"`{key}`").alias("key"), F.col("_metadata.file_path").alias("file"),
                                           F.col("_metadata.file_size").alias("size"))
    ranges = rows.groupBy("file", "size").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"))
    ranges.write.mode("overwrite").parquet(f"{index_path}/ranges")
    ranges = spark.read.parquet(f"{index_path}/ranges")
    fullest = ranges.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]
    slots = F.lit(max(1, fullest * bits_per_key // 64)).cast("long")
    bit = rows.filter("key IS NOT NULL").select("file", F.explode(F.array(*_places(F.col("key"), slots))).alias("at"))
    filters = bit.groupBy("file", F.floor(F.col("at") / 64).cast("int").alias("slot")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits")) \
        .groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias("filter"))
    ranges.join(filters, "file", "left").withColumn("slots", slots).write.mode("overwrite").parquet(f"{index_path}/files")


def candidates(spark: SparkSession, index_path: str, values: Sequence) -> DataFrame:
    """file, size, hit: the indexed files, and whether they may hold one of ``values`` (not null)."""
    index = spark.read.parquet(f"{index_path}/files")
    kind = index.schema["low"].dataType

    def may_hold(v: Column) -> Column:
        inside = (F.col("low") <= v) & (v <= F.col("high"))
        for at in _places(v, F.col("slots")):
            slot = F.coalesce(F.try_element_at("filter", F.floor(at / 64).cast("int")), F.lit(0).cast("long"))
            inside = inside & (F.call_function("getbit", slot, (at % 64).cast("int")) == 1)
        return inside

    wanted = F.array(*[F.lit(v).cast(kind) for v in values if v is not None]) if any(v is not None for v in values) else F.array().cast(f"array<{kind.simpleString()}>")
    return index.select("file", "size", F.coalesce(F.exists(wanted, may_hold), F.lit(False)).alias("hit"))


def lookup(spark: SparkSession, path: str, index_path: str, key: str, values: Sequence) -> DataFrame:
    """Rows below ``path`` whose ``key`` is among a few known values; opens only files that may hold one."""
    there = spark.read.parquet(path)
    # the files as they are now: a listing, no file is opened
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path) \
        .select("path", F.col("length").alias("size"), plain("path").alias("file"))
    without = candidates(spark, index_path, values).filter("NOT hit").select(plain("file").alias("file"), "size")
    keep = [r[0] for r in now.join(without, ["file", "size"], "left_anti").select("path").collect()]  # names, as the scan's own listing
    if not keep:
        return there.limit(0)
    return spark.read.schema(there.schema).option("basePath", path).parquet(*keep).filter(F.col(f"`{key}`").isin([v for v in values if v is not None]))
