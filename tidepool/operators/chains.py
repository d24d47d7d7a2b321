"""Chains by pointer doubling.

A recursion takes a round for every link. Here every node points to its next
one, and in each round to where that one points: after r rounds a pointer
spans 2 ** r links, so a chain of n nodes takes about log2(n) rounds. Nodes that
have reached an end leave, so pointers of the nodes still on the way go to different nodes
and no end becomes a hot key. Every round is written, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_path


def ends(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, end, steps) of every node of ``links`` (node, next; a null next ends a chain), and
    the rounds taken. A node is named once and follows one node at most; a circle is an error."""
    spark, path = links.sparkSession, work_path(links.sparkSession, "chains")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    links = written(links.select("node", "next"), "links")
    last = links.filter("next IS NULL").select("node")
    total = links.count()
    done = [last.select("node", F.col("node").alias("end"), F.lit(0).cast("long").alias("steps"))]
    # "to" is the node that lies "steps" links on; "ended": it is its chain's last
    state = written(links.filter("next IS NOT NULL").select("node", F.col("next").alias("to"), F.lit(1).cast("long").alias("steps"))
                    .join(last.select(F.col("node").alias("to"), F.lit(True).alias("ended")), "to", "left")
                    .select("node", "to", "steps", F.coalesce("ended", F.lit(False)).alias("ended")), "0")
    rounds, reached = 0, None  # all that have reached an end so far: others still point to them
    while True:
        fresh = state.filter("ended").select("node", "to", "steps", "ended")
        reached = fresh if reached is None else reached.unionByName(fresh)
        going = state.filter("NOT ended")
        if not going.limit(1).count():
            break
        if 1 << rounds > total:
            raise ValueError("the links have a circle, or go to nodes that are not there")
        rounds += 1
        ahead = going.unionByName(reached).select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"), F.col("ended").alias("then"))
        state = written(going.drop("ended").join(ahead, "to").select(
            "node", F.col("to2").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("then").alias("ended")), str(rounds))
    done.append(reached.select("node", F.col("to").alias("end"), "steps"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, rounds
