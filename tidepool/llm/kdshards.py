"""Sharding by k-d tree partitioning.

Documents are points of metadata (here size and a checksum of the text). A
node that must give k shards is split along its widest dimension (width
against the root's) at a weighted median: the place where the bytes divide as
the shards do. Medians are found on the cluster for all nodes of a level at
once, by histograms that halve in on the value: what reaches the driver is
bins per open node, whatever the number of rows.

Equal texts are equal points and stay in one shard. Only where the rows at the
median value weigh more than ``tolerance`` of a shard are they divided, in
order of a hash and the id, so that one huge group of copies doesn't unbalance
the shards.

Results by case: a null text has size 8 and the checksum of the empty text;
repeated rows are placed one by one; fewer rows than shards leave shards empty;
an empty table gives an empty table; columns named like the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path
from .common import without

BINS = 1024
ROWS_PER_RUN = 50_000  # rows numbered in one sorted run


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _of_node(values: dict[int, object], cast: str, node: str = "node") -> Column:
    """A literal per node (as many as there are shards at most)."""
    if not values:
        return F.lit(None).cast(cast)
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(cast))]
    return F.element_at(F.create_map(*pairs), F.col(node))


def _median(points: DataFrame, dims: list[str], todo: dict[int, tuple[str, int, int, float]]) -> dict[int, tuple[int, float, float]]:
    """For each node (dimension, lowest, highest, share of the bytes on the left):
    the value where that share is reached, the bytes below it and the bytes at it."""
    low = {n: t[1] for n, t in todo.items()}
    high = {n: t[2] for n, t in todo.items()}
    goal, below = {}, {n: 0.0 for n in todo}
    value = F.coalesce(*[F.when(_of_node({n: t[0] for n, t in todo.items()}, "string") == d, F.col(d)) for d in dims])
    base = points.filter(F.col("node").isin(list(todo))).select("node", value.alias("v"), "weight")
    total = {r[0]: float(r[1]) for r in base.groupBy("node").agg(F.sum("weight")).collect()}
    goal = {n: t[3] * total[n] for n, t in todo.items()}
    at: dict[int, float] = {}
    open_ = set(todo)
    while open_:
        # bins of width 1 at last; each round narrows the range BINS times
        width = {n: max(1, -(-(high[n] - low[n] + 1) // BINS)) for n in open_}
        lo, w = _of_node({n: low[n] for n in open_}, "long"), _of_node(width, "long")
        rows = base.filter(F.col("node").isin(list(open_))).filter(
            (F.col("v") >= lo) & (F.col("v") <= _of_node({n: high[n] for n in open_}, "long"))) \
            .groupBy("node", F.floor((F.col("v") - lo) / w).cast("long").alias("bin")) \
            .agg(F.sum("weight").alias("weight")).collect()
        bins: dict[int, list[tuple[int, float]]] = {}
        for n, b, x in rows:
            bins.setdefault(n, []).append((b, float(x)))
        for n in list(open_):
            got = sorted(bins[n])
            for b, x in got:
                if below[n] + x >= goal[n] or (b, x) == got[-1]:
                    low[n], high[n] = low[n] + b * width[n], min(high[n], low[n] + (b + 1) * width[n] - 1)
                    at[n] = x
                    break
                below[n] += x
            if width[n] == 1:
                high[n] = low[n]
                open_.discard(n)
    return {n: (low[n], below[n], at[n]) for n in todo}


def shard(rows: DataFrame, shards: int, weight: Column, dims: dict[str, Column], order: list[Column],
          tolerance: float = 0.02) -> DataFrame:
    """Append ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each).

    ``dims``: whole-number dimensions; ``order``: what divides a group of equal
    points too heavy for one shard (a hash of it is used first).
    """
    spark = rows.sparkSession
    rows = without(rows, ("shard", "slot"))
    staged = work_path(spark, "kdshards")
    names = [f"_d{i}" for i in range(len(dims))]
    # the user's columns in one, so that none of their names can clash; a row's place divides equal rows
    rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_rest"), weight.alias("_w"),
                *[c.cast("long").alias(n) for n, c in zip(names, dims.values())], order[0].alias("_first"),
                F.xxhash64(*order, F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 31) - 1)).alias("_o")).write.parquet(f"{staged}/rows")
    base = spark.read.parquet(f"{staged}/rows")
    dims_all = [*names, "_o"]
    points = base.select(*[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in dims_all], F.col("_w").alias("weight"))

    tree: dict[int, tuple[int, int]] = {0: (0, shards)}  # open node -> (first shard, shards)
    rules: list[tuple[int, Column, int, int]] = []       # splits in order: node, goes left, left node, right node
    done: dict[int, int] = {}
    node, fresh, root = F.lit(0), 1, None
    while tree:
        for n, (first, k) in list(tree.items()):
            if k == 1:
                done[n] = first
                del tree[n]
        if not tree:
            break
        placed = points.withColumn("node", node)
        ranges = placed.filter(F.col("node").isin(list(tree))).groupBy("node").agg(
            *[f(d).alias(f"{p}{d}") for d in names for p, f in (("lo", F.min), ("hi", F.max))], F.sum("weight").alias("total")).collect()
        if root is None:
            root = {d: max(1, ranges[0][f"hi{d}"] - ranges[0][f"lo{d}"]) for d in names} if ranges else {}
        todo = {}
        for r in ranges:
            k = tree[r["node"]][1]
            d = max(names, key=lambda d: ((r[f"hi{d}"] - r[f"lo{d}"]) / root[d], -names.index(d)))
            todo[r["node"]] = (d, r[f"lo{d}"], r[f"hi{d}"], (k // 2) / k)
        for n in set(tree) - set(todo):  # nothing lies there
            done[n] = tree.pop(n)[0]
        if not todo:
            break
        totals = {r["node"]: float(r["total"]) for r in ranges}
        cuts, left, heavy = _median(placed, names, todo), {}, {}
        for n, (v, below, at) in cuts.items():
            goal, slack = todo[n][3] * totals[n], tolerance * totals[n] / tree[n][1]
            # the nearer side of the group, unless that is too far off
            if min(abs(below - goal), abs(below + at - goal)) <= slack:
                left[n] = (todo[n][0], v, abs(below + at - goal) <= abs(below - goal))
            else:
                heavy[n] = (todo[n][0], v, goal - below)
        # inside a heavy value: first the other dimensions, then the hashed order
        inside = {n: [d for d in dims_all if d != heavy[n][0]] for n in heavy}
        cond: dict[int, Column] = {n: (F.col(d) < v) | (F.lit(incl) & (F.col(d) == v)) for n, (d, v, incl) in left.items()}
        fixed = {n: (F.col(d) < v, F.col(d) == v, goal) for n, (d, v, goal) in heavy.items()}
        while fixed:
            step, nodes = {}, {n: inside[n].pop(0) for n in fixed}
            at_value = placed.filter(F.coalesce(*[F.when(F.col("node") == n, f[1]) for n, f in fixed.items()], F.lit(False)))
            spans = at_value.groupBy("node").agg(*[f(d).alias(f"{p}{d}") for d in dims_all for p, f in (("lo", F.min), ("hi", F.max))],
                                                 F.sum("weight").alias("total")).collect()
            for r in spans:
                d = nodes[r["node"]]
                step[r["node"]] = (d, r[f"lo{d}"], r[f"hi{d}"], min(1.0, max(0.0, fixed[r["node"]][2] / float(r["total"]))))
            for n, (v, below, at) in _median(at_value, dims_all, step).items():
                sure, same, goal = fixed.pop(n)
                d, slack = step[n][0], tolerance * totals[n] / tree[n][1]
                if min(abs(below - goal), abs(below + at - goal)) <= slack or not inside[n]:
                    take = F.lit(abs(below + at - goal) <= abs(below - goal))
                    cond[n] = sure | (same & ((F.col(d) < v) | (take & (F.col(d) == v))))
                else:
                    fixed[n] = (sure | (same & (F.col(d) < v)), same & (F.col(d) == v), goal - below)
        for n in todo:
            first, k = tree.pop(n)
            rules.append((n, cond[n], fresh, fresh + 1))
            tree[fresh], tree[fresh + 1] = (first, k // 2), (first + k // 2, k - k // 2)
            fresh += 2
        node = _walk(0, {r[0]: r[1:] for r in rules})
    shard_of = _of_node(done, "int", "_node") if done else F.lit(0)
    out = base.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in dims_all}).withColumn("_node", node) \
        .withColumn("shard", shard_of).drop("_node", "_w", *names)
    return number(out, f"{staged}/placed").select(*[F.col("_rest").getField(c).alias(c) for c in rows.columns], "shard", "slot")


def _walk(n: int, rules: dict[int, tuple[Column, int, int]]) -> Column:
    """The tree as one expression: the leaf that a row falls into."""
    if n not in rules:
        return F.lit(n)
    cond, left, right = rules[n]
    return F.when(cond, _walk(left, rules)).otherwise(_walk(right, rules))


def number(rows: DataFrame, path: str) -> DataFrame:
    """``slot``: gapless in each shard. Shards are numbered in runs of bounded
    length (by the hash ``_o``); a run starts after the rows of the runs before it."""
    total = rows.count()
    runs = max(1, -(-total // ROWS_PER_RUN))
    rows.withColumn("_run", F.col("_o") % runs).write.parquet(path)
    rows = rows.sparkSession.read.parquet(path)
    sizes = rows.groupBy("shard", "_run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("shard", "_run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_first", "_o"))) \
        .join(start, ["shard", "_run"]).withColumn("slot", (F.col("_start") + F.col("_n") - 1).cast("long")) \
        .drop("_run", "_n", "_start", "_first", "_o")
