"""Windows over hot keys by two-pass segmented prefix sums.

A window function runs all rows of a key in one task. Here the rows are
range-partitioned by (key, order), so a hot key lies in many partitions, and numbered
there. Two passes: each partition's rows, distinct order values and sums of a key that goes
over a border are added up (a row per key and partition), these are summed
over the partitions before, and the partition's own windows start from that.
A task reads one partition's rows, however hot a key is. Rows that are equal in
key and order lie together, since they are peers of each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None,
            partitions: int | None = None) -> DataFrame:
    """Append row_number, rank, dense_rank over ``keys`` ordered by ``order``, and for each
    of ``sums`` (name -> whole or decimal number) its running sum, peers included. Rows that are
    equal in ``order`` get their row_numbers in the order they are read.

    Columns of ``df`` named like the new ones are replaced."""
    sums = sums or {}
    spark, path = df.sparkSession, work_path(df.sparkSession, "ordered")
    cols = [c for c in df.columns if c not in ("row_number", "rank", "dense_rank", *sums)]
    plain = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)],
                      *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)], *[c.alias(f"s{i}") for i, c in enumerate(sums.values())])
    k, o, s = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))], [f"s{i}" for i in range(len(sums))]
    dealt = plain.repartitionByRange(*k, *o) if partitions is None else plain.repartitionByRange(partitions, *k, *o)
    dealt.sortWithinPartitions(*k, *o).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()) \
        .write.parquet(f"{path}/sorted")
    rows = spark.read.parquet(f"{path}/sorted")
    # keys that go over a border: at most two a partition come or go on
    ends = rows.groupBy("part").agg(F.min(F.struct(*k)).alias("low"), F.max(F.struct(*k)).alias("high"))
    ends = ends.select(F.explode(F.array("low", "high")).alias("k"), "part").distinct()
    crossing = ends.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select(*[F.col(f"k.{c}") for c in k])
    crossing.write.parquet(f"{path}/crossing")
    crossing = spark.read.parquet(f"{path}/crossing")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in k]
    over = rows.alias("r").join(F.broadcast(crossing.alias("c")), _all(same("r", "c")), "left_semi")
    per = over.groupBy(*k, "part").agg(F.count("*").alias("n"), F.count_distinct(F.struct(*o)).alias("d"), *[F.sum(c).alias(c) for c in s])
    earlier = Window.partitionBy(*k).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per.select(*k, "part", *[F.sum(c).over(earlier).alias(f"b_{c}") for c in ("n", "d", *s)]).write.parquet(f"{path}/base")
    # at most two rows a partition: a broadcast that the number of partitions bounds
    base = F.broadcast(spark.read.parquet(f"{path}/base")).alias("b")
    own = Window.partitionBy("part", *k)
    peers = own.orderBy(*o)
    numbered = rows.select("*", F.row_number().over(own.orderBy("place")).alias("i"), F.rank().over(peers).alias("r"), F.dense_rank().over(peers).alias("d"),
                           *[F.sum(c).over(peers).alias(f"t_{c}") for c in s]).alias("r")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = numbered.join(base, (F.col("r.part") == F.col("b.part")) & _all(same("r", "b")), "left")
    return out.select(*[F.col("row").getField(c).alias(c) for c in cols], (F.col("i") + zero("b_n")).cast("long").alias("row_number"),
                      (F.col("r") + zero("b_n")).cast("long").alias("rank"), (F.col("r.d") + zero("b_d")).cast("long").alias("dense_rank"),
                      *[(F.col(f"t_{c}") + zero(f"b_{c}")).alias(n) for c, n in zip(s, sums)])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
