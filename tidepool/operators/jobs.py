"""Jobs the platform runs on Spark (J01): Monte Carlo estimate of pi.

The sampling is a map over rows and one global average: a partial sum and
count per task, one merge. Nothing but two numbers per task moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The bundled example's default slice count; samples per slice.
DEFAULT_SLICES = 1000
SAMPLES_PER_SLICE = 100_000


def pi_from_points(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(samples, pi) from points in the unit square: 4 * share inside the circle."""
    inside = F.when(F.col(x) * F.col(x) + F.col(y) * F.col(y) <= F.lit(1.0), F.lit(1.0)) \
        .otherwise(F.lit(0.0))
    return points.agg(F.count(F.lit(1)).alias("samples"),
                      (F.lit(4.0) * F.avg(inside)).alias("pi"))


def random_points(spark: SparkSession, slices: int = DEFAULT_SLICES,
                  per_slice: int = SAMPLES_PER_SLICE, seed: int = 42) -> DataFrame:
    """``slices * per_slice`` uniform points, generated in ``slices`` tasks."""
    return spark.range(0, slices * per_slice, numPartitions=slices).select(
        F.rand(seed).alias("x"), F.rand(seed + 1).alias("y"))


def congruential_point(a: Column, b: Column) -> tuple[Column, Column]:
    """A deterministic point from two integer keys (integer congruences), so
    another engine can compute exactly the same sample."""
    x = F.pmod(a * F.lit(7919) + b * F.lit(104729), F.lit(10007)).cast("double") / F.lit(10007.0)
    y = F.pmod(a * F.lit(104723) + b * F.lit(7927), F.lit(10009)).cast("double") / F.lit(10009.0)
    return x, y


def pi_estimate(spark: SparkSession, slices: int = DEFAULT_SLICES,
                per_slice: int = SAMPLES_PER_SLICE, seed: int = 42) -> DataFrame:
    """The bundled example job: ``run-example SparkPi <slices>``."""
    return pi_from_points(random_points(spark, slices, per_slice, seed))
