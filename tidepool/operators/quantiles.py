"""Exact percentiles by selection.

``percentile`` holds every distinct value of a group in one task. Here each
wanted rank is searched by histogram: the range that holds it is cut into equal
bins, the bins are counted (before the shuffle, in each task), and the bin that
holds the rank is the next range, until it holds few values or one value only.
Those few are ranked. Two or three passes over the column, a few hundred counts
per group and rank each; no task holds a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path

BINS = 256
RANKED = 10_000  # most values of a group and rank that are ranked at last


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], ranked: int = RANKED) -> DataFrame:
    """keys, p (a share from 0 to 1), value (double): as ``quantile_cont`` interpolates.

    Null and NaN values do not count; a group without others has no rows."""
    spark, path = df.sparkSession, work_path(df.sparkSession, "quantiles")
    k = [f"k{i}" for i in range(len(keys))]
    data = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, k)], F.col(f"`{value}`").cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")

    def written(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    start = data.groupBy(*k).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.col("p") * (F.col("n") - 1)
    wanted = written(start.select("*", F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("p"))
                     .select("*", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("at"), place.alias("place")), "wanted")
    # a range for each group and rank: what lies below it, how many it holds
    state = written(wanted.select(*k, "at", "low", "high", "n", F.lit(0).cast("long").alias("below")).distinct(), "range0")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in k]
    inside = lambda s: data.alias("d").join(s.alias("s"), [*same, F.col("v") >= F.col("low"), F.col("v") <= F.col("high")])
    turn = 0
    while state.filter((F.col("low") < F.col("high")) & (F.col("n") > ranked)).limit(1).count():
        turn += 1
        wide = state.filter((F.col("low") < F.col("high")) & (F.col("n") > ranked))
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves: the span may not fit a double
        bins = inside(wide).withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")) \
            .groupBy(*[F.col(f"s.{c}") for c in k], "at", "below", "bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        # at most BINS rows a window
        upto = F.sum("n").over(Window.partitionBy(*k, "at").orderBy("bin"))
        held = bins.withColumn("upto", F.col("below") + upto).withColumn("under", F.col("upto") - F.col("n")) \
            .filter((F.col("under") <= F.col("at")) & (F.col("at") < F.col("upto"))) \
            .select(*k, "at", "low", "high", "n", F.col("under").alias("below"))
        state = written(state.filter("NOT (low < high AND n > " + str(ranked) + ")").unionByName(held), f"range{turn}")
    few = inside(state.filter("low < high")).select(*[F.col(f"s.{c}") for c in k], "at", "below", "v")
    by_value = Window.partitionBy(*k, "at").orderBy("v")
    found = few.withColumn("i", F.col("below") + F.row_number().over(by_value) - 1).filter("i = at").select(*k, "at", "v")
    found = written(found.unionByName(state.filter("low >= high").select(*k, "at", F.col("low").alias("v"))), "found")
    both = wanted.select(*k, "p", "at", "place").alias("d").join(found.alias("s"), [*same, F.col("d.at") == F.col("s.at")]) \
        .groupBy(*[F.col(f"d.{c}") for c in k], "p", "place").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return both.select(*[F.col(n).alias(c) for c, n in zip(keys, k)], "p",
                       (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("value"))
