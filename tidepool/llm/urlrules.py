"""URL rules by a sort-merge range join.

A rule (host, path) covers the host, its subdomains, and every path that
starts with the rule's. With the host's labels reversed, "this host or below"
is a prefix of the key, and a prefix is an interval of sorted keys. Keys start
with the path prefix, so the two prefixes of a rule make one interval; a page
takes part once per distinct length of rule path.

Pages and the two ends of each interval are sorted together. Intervals nest
or are disjoint, so one sweep with a stack finds the innermost rule open at
each page. The stack is kept by window functions: the depth is the running
count of opened less closed intervals, slot d holds the rule opened last at
depth d. Rows are range-partitioned on (key, row), so neither a frequent host
nor a frequent url fills one task, and each partition starts with the stack
that the partitions before it leave.

Results by case: a url that is null or has no ``://`` has empty host and path
and no rule; repeated pages get a row each; the longest rule wins (host plus
path), ties go to the longer path; no rules: all pages get ``default``;
an empty table gives an empty table; columns named like the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path
from .common import ascii_lower, shielded

_LAST = "\U0010FFFF"  # sorts after every character of a host


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``a.example.com`` -> ``com.example.a.``: subdomains share the prefix."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Append host, path, rule (null if none) and verdict to ``pages``.

    ``rules``: columns host, path, verdict. A rule's name is host followed by path.
    """
    return shielded(pages, (url,), ("host", "path", "rule", "verdict"), lambda p: _judged(p, rules, url, default))


def _judged(pages: DataFrame, rules: DataFrame, url: str, default: str) -> DataFrame:
    spark = pages.sparkSession
    # rows keep a number of their own through the sweep: a table written once,
    # so that a task that runs again finds the same numbers
    staged = work_path(spark, "urlrules")
    pages.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{staged}/pages")
    kept = spark.read.parquet(f"{staged}/pages").withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})

    rules = rules.select(ascii_lower(F.col("host")).alias("_rhost"), F.col("path").alias("_rpath"), F.col("verdict").alias("_verdict")) \
        .dropna().groupBy("_rhost", "_rpath").agg(F.min("_verdict").alias("_verdict"))
    rules = rules.withColumns({
        "_rule": F.concat("_rhost", "_rpath"), "_low": F.concat(F.col("_rpath"), F.lit("\x00"), reversed_host(F.col("_rhost")))})
    # one row per distinct length of rule path: a handful, set by the rules' paths alone
    lengths = [r[0] for r in rules.select(F.length("_rpath")).distinct().collect()]

    events = rules.select(F.col("_low").alias("key"), F.lit(1).alias("kind"), F.lit(-1).cast("long").alias("_row"),
                          F.struct(F.length("_rule").alias("size"), F.length("_rpath").alias("psize"), F.col("_rule").alias("rule"),
                                   F.col("_verdict").alias("verdict")).alias("rule"))
    ends = rules.select(F.concat("_low", F.lit(_LAST)).alias("key"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("_row"),
                        F.lit(None).cast(events.schema["rule"].dataType).alias("rule"))
    points = kept.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"))) \
        .filter((F.length("_path") >= F.col("_n")) & (F.col("_host") != "")) \
        .select(F.concat(F.substring("_path", 1, F.col("_n")), F.lit("\x00"), reversed_host(F.col("_host"))).alias("key"),
                F.lit(2).alias("kind"), "_row", F.lit(None).cast(events.schema["rule"].dataType).alias("rule"))

    # at one key, intervals close before others open, and open before pages look
    events.unionByName(ends).unionByName(points).repartitionByRange("key", "kind", "_row") \
        .withColumn("part", F.spark_partition_id()).write.parquet(f"{staged}/sorted")
    rows = spark.read.parquet(f"{staged}/sorted")
    step = F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)

    # what the partitions before one leave open: depth first, then the slots
    order = Window.partitionBy("part").orderBy("key", "kind", "_row")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # (one row per partition in these two windows)
    base = rows.groupBy("part").agg(F.sum(step).alias("up")) \
        .select("part", F.coalesce(F.sum("up").over(before), F.lit(0)).alias("base"))
    rows = rows.join(F.broadcast(base), "part") \
        .withColumn("depth", (F.col("base") + F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    deepest = rows.filter("kind = 1").agg(F.max("depth")).first()[0] or 0
    opened = rows.filter("kind = 1")
    slots = {f"slot{d}": F.when((F.col("kind") == 1) & (F.col("depth") == d), F.col("rule")) for d in range(1, deepest + 1)}
    if not deepest:
        top = rows.withColumn("top", F.col("rule"))
    else:
        left = opened.groupBy("part").agg(*[
            F.max(F.when(c.isNotNull(), F.struct("key", c.alias("rule")))).getField("rule").alias(n) for n, c in slots.items()])
        carried = base.join(left, "part", "left").select(
            "part", *[F.last(n, ignorenulls=True).over(before).alias(f"in_{n}") for n in slots])
        stack = rows.join(F.broadcast(carried), "part").withColumns(
            {n: F.coalesce(F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"in_{n}"))
             for n, c in slots.items()})
        top = stack.withColumn("top", F.when(F.col("depth") > 0, F.get(F.array(*slots), F.col("depth") - 1)))
    found = top.filter((F.col("kind") == 2) & F.col("top").isNotNull()).groupBy("_row").agg(F.max("top").alias("top"))
    return kept.join(found, "_row", "left").select(
        *[F.col(f"`{c}`") for c in pages.columns], F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
