"""A large JSON array read in parallel.

A file that holds one array of objects has no line to split at. It is read in
byte ranges as pieces that end at each closing brace (the text source finds the
pieces at range borders), and a prefix scan tells what each brace closes:

1. A piece is reduced to three numbers, without knowing what stands before it: whether its
   quotes turn "in a string" over, and how it changes the bracket depth if it
   begins outside, or inside, a string (escaped signs are passed over).
2. Running sums over the pieces of each range, and over the ranges of each
   file, give the true string state and then the true depth of every piece.
3. Where a brace closes back to depth 1, an object ends. A piece that is an
   object by itself goes straight on; the others are put together.

No file is held as one string, and a task holds one object at most. Only
built-in expressions run, so any store that Spark reads will do. A file that
is no array of objects, or is cut off, is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import work_path

_BRACE = "}"


def _outside(text: Column) -> Column:
    """What of a text that begins outside a string lies outside strings."""
    return F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '(?s)".*$', "")


def _opened(text: Column) -> Column:
    """Brackets opened less brackets closed (closing braces end pieces and are counted apart)."""
    return F.length(F.translate(text, "]", "")) - F.length(F.translate(text, "[{]", "")) - (F.length(text) - F.length(F.translate(text, "]", "")))


def _running(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all earlier pieces of the file. Sums of ranges are
    summed over the ranges, so no task reads more than its range."""
    total = rows.groupBy("file", "start").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select("file", "start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file", "start").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, ["file", "start"]).withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_base")


def objects(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``value``: the text of every object of the arrays in the files, one line each."""
    staged = work_path(spark, "json_array")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{staged}/{name}")
        return spark.read.parquet(f"{staged}/{name}")

    read = spark.read.option("lineSep", _BRACE).text(path if isinstance(path, str) else list(path))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.translate(bare, '"', ""))
    pieces = written(read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"),
        "value", (quotes % 2).cast("long").alias("turns"), _opened(_outside(bare)).cast("long").alias("from_outside"),
        _opened(_outside(F.regexp_replace(bare, '^[^"]*("|$)', ""))).cast("long").alias("from_inside")), "pieces")
    in_string = F.col("before") % 2 == 1
    ends_outside = (F.col("before") + F.col("turns")) % 2 == 0
    # the closing brace counts where it is not part of a string
    opened = F.when(in_string, F.col("from_inside")).otherwise(F.col("from_outside")) - F.when(ends_outside, 1).otherwise(0)
    stated = written(_running(pieces, "turns", "before").select(
        "file", "start", "place", "value", ends_outside.alias("outside"), opened.cast("long").alias("opened")), "stated")
    # a file begins with its array; what stands behind the last brace closes it, and has no brace itself
    first = F.min_by(F.substring(F.regexp_replace("value", r"\A\s+", ""), 1, 1), F.struct("start", "place"))
    wrong = stated.groupBy("file").agg(F.sum("opened").alias("left"), first.alias("first")) \
        .filter((F.col("left") != -1) | (F.col("first") != "[")).select("file").first()
    if wrong:
        raise ValueError(f"not an array of objects: {wrong[0]}")
    # depth 1 is the array's own
    closes = F.col("outside") & (F.col("depth") + F.col("opened") == 1)
    ended = written(_running(stated, "opened", "depth").select(
        "file", "start", "place", "value", closes.cast("long").alias("closes"), (F.col("depth") < 0).alias("beyond")), "ended")
    in_range = Window.partitionBy("file", "start").orderBy("place")
    numbered = _running(ended.withColumn("alone", (F.col("closes") == 1) & (F.lag("closes").over(in_range) == 1)), "closes", "number")
    whole = numbered.filter("alone").select("file", "value", F.lit(True).alias("closed"), F.lit(True).alias("one"))
    parts = numbered.filter("alone IS NULL OR NOT alone").groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "value"))).alias("parts"), (F.max("closes") == 1).alias("closed")) \
        .select("file", F.array_join(F.transform("parts", lambda p: p["value"]), _BRACE).alias("value"), "closed", F.lit(False).alias("one"))
    every = whole.unionByName(parts)
    # what stands before an object: the array's start or a comma; behind the last one: the array's end
    body = F.regexp_replace("value", r"\A\s*[\[,]\s*", "")
    wrong = F.when(F.col("closed"), ~body.startswith("{")).otherwise(~F.col("value").rlike(r"\A(\s*\[)?\s*\]\s*\z"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("not an array of objects: "), "file"))).otherwise(F.concat(body, F.lit(_BRACE)))
    return every.select("closed", F.regexp_replace(checked, r"[\r\n]+", " ").alias("value")).filter("closed OR value IS NULL").select("value")
