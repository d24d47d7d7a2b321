"""Joins on a range alone: points in intervals without an equality key.

An interval of whole numbers is the exact union of few cells of a grid with
cells of 1, 16, 256, ... numbers; a point lies in one cell of each size. So the
join becomes an equality join on (size, cell), without a nested loop: a long interval has few
large cells, and its pairs come out once, as its cells do not overlap. Only
the sizes that some interval uses are joined. The points of a crowded cell are dealt over
slices, and the cell's intervals are put into each of them: one more row of an interval
for every ``SLICE`` pairs. There are as many partitions as the points call for, so what a
task sorts does not grow with the input.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP = 4                   # a cell has 2 ** STEP cells of the next smaller size
LEVELS = tuple(range(0, 60, STEP))
SLICE = 1 << 18            # points of a cell that are joined together
TASK = 1 << 20             # points and intervals a partition, on average
_EDGE = 1 << 58            # numbers beyond lie in the outermost cells


def whole(c: Column, kind: str) -> Column:
    """A date or time as a whole number, in order."""
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("long")


def _cells(low: Column, high: Column) -> Column:
    """The cells (level, cell) that make up the whole numbers from low to high."""
    out = []
    first = lambda level: -F.shiftright(-low, level)  # noqa: E731  the first whole cell of a size, and the one behind the last
    behind = lambda level: F.shiftright(high + 1, level)
    for level in LEVELS:
        a, b, up = first(level), behind(level), level + STEP
        some = first(up) < behind(up) if up in LEVELS else F.lit(False)
        left, right = F.least(b, F.shiftleft(first(up), STEP)), F.greatest(a, F.shiftleft(behind(up), STEP))
        run = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<long>"))
        cells = F.when(some, F.concat(run(a, left), run(right, b))).otherwise(run(a, b))
        out.append(_at_level(cells, level))
    return reduce(F.concat, out)


def _at_level(cells: Column, level: int) -> Column:
    return F.transform(cells, lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str) -> DataFrame:
    """Every pair of a point and an interval with ``low <= at <= high``: the columns of both.

    The three columns are whole numbers, dates, or times; null ends and empty intervals hold nothing."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    clip = lambda c: F.greatest(F.lit(-_EDGE), F.least(F.lit(_EDGE), c))
    ends = intervals.select(F.struct("*").alias("interval"), clip(whole(F.col(low), kind(intervals, low))).alias("low"),
                            clip(whole(F.col(high), kind(intervals, high))).alias("high")).filter("low <= high")
    cells = ends.select("interval", F.inline(_cells(F.col("low"), F.col("high"))))
    # the sizes in use: one row of at most as many numbers as there are sizes
    used, n = cells.agg(F.collect_set("level"), F.count("*")).first()
    used = sorted(used)
    place = clip(whole(F.col(at), kind(points, at)))
    there = points.filter(F.col(at).isNotNull())
    levels = F.explode(F.array(*[F.lit(n) for n in used]).cast("array<int>")).alias("level")
    cell = F.expr("shiftright(at, level)").alias("cell")
    # the crowded cells: at most a row for every SLICE points of a size
    crowded = F.broadcast(there.select(place.alias("at"), levels).groupBy("level", cell).count().filter(F.col("count") > SLICE)
                          .select("level", "cell", F.ceil(F.col("count") / SLICE).alias("slices")))
    of_cell = F.coalesce("slices", F.lit(1))
    here = there.select(F.struct("*").alias("point"), place.alias("at"), F.monotonically_increasing_id().alias("nr")) \
        .select("point", "nr", "at", levels).select("point", "nr", "level", cell) \
        .join(crowded, ["level", "cell"], "left").select("point", "level", "cell", F.pmod("nr", of_cell).alias("slice"))
    cells = cells.join(crowded, ["level", "cell"], "left").select("interval", "level", "cell", F.explode(F.sequence(F.lit(0).cast("long"), of_cell - 1)).alias("slice"))
    keys = ["level", "cell", "slice"]
    parts = max(points.sparkSession.sparkContext.defaultParallelism, math.ceil((there.count() * len(used) + n) / TASK))
    return here.repartition(parts, *keys).join(cells.repartition(parts, *keys), keys).select("point.*", "interval.*")
