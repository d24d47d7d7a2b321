"""Conversation structure repair by a square-root checkpointed dynamic programme.

A conversation's role initials should read ``(s?(ua)+)?``. Its rows, in the
order of their turns, are kept, given another role, deleted, or preceded by new
empty messages, at least total cost; of the cheapest edits the one whose
letters (D, I, K, R) come first in ASCII order is taken.

There are four states: nothing yet, after s, after u, after a. The least cost of
what is still to come, for each state, is a vector that a row changes by a
4 x 4 (min, +) step. Rows are cut into blocks. Only the vectors at the blocks'
ends ("checkpoints") are kept: each block is reduced to its 4 x 4 matrix, the
matrices of a conversation are folded backwards, and then every block is
computed anew from its checkpoint and walked forwards, taking at each place the
first letter that is tight (its cost plus the cost to come is the vector's
value). Inside a block, the same is done once more: only every square root of
its rows a vector is kept, and the stretch between two of them is computed
again when the walk gets there.

Blocks have at most about the square root of all rows (at least ``LEAST_BLOCK``),
so a conversation that holds a third of the table is spread over as many tasks
as it has blocks, and what is gathered for one conversation is a matrix per
block. Equal rows of one turn are one line with a count.

Results by case: null conversation, role and text count as one space, a null
turn comes first; rows of one turn stand in the order of role, the text's first 64
characters and a digest; a conversation all of whose rows are dropped has zeros and an empty audit; texts are whole;
an empty table gives empty tables; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path

LEAST_BLOCK = 1024
FAR = 1 << 50  # a cost that is never reached
ENTER, AFTER_S, AFTER_U, AFTER_A = range(4)
# Edit costs.
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
# The state after a new or rewritten message, and its role.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NEW_ROLE = ("user", "user", "assistant", "user")
KEEPS = {"s": {ENTER: AFTER_S}, "u": {ENTER: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, "a": {AFTER_U: AFTER_A}}
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"
END = (0, INSERT_COST * 2, INSERT_COST, 0)  # the costs after the last row

Vector = tuple[int, int, int, int]


class Edits(NamedTuple):
    """Conversations after repair.

    ``turns``: conv_id, place, part (rows of a place in order), role, text, edit;
    ``report``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    """
    turns: DataFrame
    report: DataFrame


def relaxed(v: list[int]) -> Vector:
    """The vector where new messages may be put in before going on."""
    u, a = min(v[AFTER_U], INSERT_COST + v[AFTER_A]), min(v[AFTER_A], INSERT_COST + v[AFTER_U])
    return min(v[ENTER], INSERT_COST + u), min(v[AFTER_S], INSERT_COST + u), u, a


def before(line: tuple[str, str, int], v: Vector) -> Vector:
    """The costs before a line (initial, fault, number of copies), from those after it."""
    initial, fault, copies = line
    if fault in (BLANK, DUPLICATE):
        return relaxed([x + DELETE_COST * copies for x in v])
    v = relaxed([x + DELETE_COST * (copies - 1) for x in v]) if copies > 1 else v
    more, keeps, out = TRUNCATED_COST * (fault == TRUNCATED), KEEPS.get(initial, {}), []
    for q in range(4):
        best = min(DELETE_COST + v[q], REROLE_COST + more + v[NEXT[q]])
        out.append(min(best, more + v[keeps[q]]) if q in keeps else best)
    return relaxed(out)


def step(line: tuple[str, str, int], q: int, v: Vector, after: Vector) -> tuple[str, int, list[tuple[str, int]]]:
    """The first tight letters at a line from state q: what is put in, then the line's own
    letters. Gives the letters, the state behind, and (letter, state behind) of each."""
    initial, fault, copies = line
    rest = after if copies == 1 or fault in (BLANK, DUPLICATE) else relaxed([x + DELETE_COST * (copies - 1) for x in after])
    more, out = TRUNCATED_COST * (fault == TRUNCATED), []
    while True:
        if fault in (BLANK, DUPLICATE):
            out += [("D", q)] * copies
            break
        keeps = KEEPS.get(initial, {})
        if v[q] == DELETE_COST + rest[q]:
            out.append(("D", q))
        elif v[q] == INSERT_COST + v[NEXT[q]]:
            q = NEXT[q]
            out.append(("I", q))
            continue
        elif q in keeps and v[q] == more + rest[keeps[q]]:
            q = keeps[q]
            out.append(("K", q))
        else:
            q = NEXT[q]
            out.append(("R", q))
        # the other copies go; where it is tight, D comes before I
        out += [("D", q)] * (copies - 1)
        break
    return "".join(c for c, _ in out), q, out


def matrix(lines: list[tuple[str, str, int]]) -> np.ndarray:
    """Costs from the state before a block (row) to the state behind it (column)."""
    columns = []
    for end in range(4):
        v = [FAR] * 4
        v[end] = 0
        v = relaxed(v)
        for line in reversed(lines):
            v = before(line, v)
        columns.append(v)
    return np.minimum(np.array(columns, np.int64).T, FAR)


def walk(lines: list[tuple[str, str, int]], q: int, last: Vector) -> tuple[list[list[tuple[str, int]]], int]:
    """The edits of each line of a block entered in state q with the costs ``last`` behind
    it, and the state behind. Keeps a vector for every square root of the lines."""
    n = len(lines)
    stride = max(1, isqrt(n))
    marks: dict[int, Vector] = {n: last}
    v = last
    for i in range(n - 1, -1, -1):
        v = before(lines[i], v)
        if i % stride == 0:
            marks[i] = v
    out = []
    for start in range(0, n, stride):
        stop = min(n, start + stride)
        vectors = [marks[stop]]
        for i in range(stop - 1, start - 1, -1):
            vectors.append(before(lines[i], vectors[-1]))
        vectors.reverse()
        for i in range(start, stop):
            _, q, made = step(lines[i], q, vectors[i - start], vectors[i - start + 1])
            out.append(made)
    return out, q


def closing(q: int) -> list[tuple[str, int]]:
    """The messages put in behind the last row."""
    out = []
    while q in (AFTER_S, AFTER_U):
        q = NEXT[q]
        out.append(("I", q))
    return out


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the planted damage that crc32 of ``conv_id:turn``, mod 20, names:
    0 drops the row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it, 4 gives it the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")) \
        .filter("kind != 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                                    text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _lines_of(entries: pa.Scalar) -> list[tuple[str, str, int]]:
    v = entries.values
    return list(zip(v.field(1).to_pylist(), v.field(2).to_pylist(), v.field(3).to_pylist()))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, entries) of blocks to (first, matrix)."""
    for b in batches:
        made = [matrix(_lines_of(e)).ravel().tolist() for e in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.int64()))], names=["first", "matrix"])


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blocks: first, matrix in order) of a conversation to (first, costs behind each block)."""
    for b in batches:
        for blocks in b.column(0):
            firsts, steps = blocks.values.field(0), blocks.values.field(1).to_pylist()
            v, out = np.array(END, np.int64), []
            for m in reversed(steps):
                out.append(v.tolist())
                v = (np.array(m, np.int64).reshape(4, 4) + v).min(1)
            yield pa.RecordBatch.from_arrays([firsts, pa.array(out[::-1], pa.list_(pa.int64()))], names=["first", "behind"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, entries, behind) to (first, exits): the state behind the block for each state before it."""
    for b in batches:
        exits = [[walk(_lines_of(e), q, tuple(v.as_py()))[1] for q in range(4)] for e, v in zip(b.column(1), b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exits, pa.list_(pa.int32()))], names=["first", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blocks: first, exits in order) of a conversation to (first, state before the block)."""
    for b in batches:
        for blocks in b.column(0):
            q, out = ENTER, []
            for exits in blocks.values.field(1).to_pylist():
                out.append(q)
                q = exits[q]
            yield pa.RecordBatch.from_arrays([blocks.values.field(0), pa.array(out, pa.int32())], names=["first", "enter"])


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entries, behind, enter, last block) to the edits of each line: (place, edits, roles, cost).

    ``roles`` has a role for each edit: that of the message, '' where the line keeps its own.
    """
    for b in batches:
        place, edits, roles, cost = [], [], [], []
        for e, v, q, last in zip(*b.columns[:4]):
            lines = _lines_of(e)
            made, q = walk(lines, q.as_py(), tuple(v.as_py()))
            if last.as_py():
                made[-1] = made[-1] + closing(q)
            place += e.values.field(0).to_pylist()
            for line, steps in zip(lines, made):
                letters = "".join(c for c, _ in steps)
                edits.append(letters)
                roles.append([("user", "assistant")[s == AFTER_A] if c in "IR" else "" for c, s in steps])
                kept = TRUNCATED_COST if line[1] == TRUNCATED and ("K" in letters or "R" in letters) else 0
                cost.append(DELETE_COST * letters.count("D") + REROLE_COST * letters.count("R") + INSERT_COST * letters.count("I") + kept)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(edits, pa.string()), pa.array(roles, pa.list_(pa.string())),
                                          pa.array(cost, pa.int64())], names=["place", "edits", "roles", "cost"])


def repair(conversations: DataFrame, rows: DataFrame | None = None, least_block: int = LEAST_BLOCK) -> Edits:
    """The cheapest edits that put every conversation's roles in order.

    ``rows``: what is to be repaired (conv_id, turn, role, text, copies), the
    conversations' own rows where left out; every conv_id of ``conversations`` is reported.
    """
    spark = conversations.sparkSession
    path = work_path(spark, "conversations")

    def written(df: DataFrame, name: str) -> DataFrame:
        """A table in the shared folder: computed once, and it cuts the lineage."""
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    if rows is None:
        rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.lit(1).alias("copies"))
    # equal rows of a turn are one line
    lines = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    whole = lines.select("*", F.md5(F.concat_ws("\u0000", "role", "text")).alias("said"),
                         F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).alias("last"),
                         F.substring("role", 1, 1).alias("initial"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), "said"]
    whole = written(whole.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("place", F.monotonically_increasing_id()), "lines")
    # a line is a duplicate if an earlier one says the same
    said_first = whole.groupBy("conv_id", "said").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    fault = F.when(F.col("last") == "", BLANK).when(F.col("is_first").isNull(), DUPLICATE) \
        .when(~F.col("last").rlike("[.!?]"), TRUNCATED).otherwise(SOUND)
    judged = written(whole.drop("text", "role", "said").join(said_first, "place", "left")
                     .select("conv_id", "turn", "place", "initial", fault.alias("fault"), "copies"), "judged")
    size = max(least_block, isqrt(judged.count()) + 1)
    # a place is a partition's number and the row's number in it: blocks are runs of places
    block = F.shiftright("place", 33) * (1 << 33) + F.floor((F.col("place") % (1 << 33)) / size) * size
    blocks = written(judged.groupBy("conv_id", block.alias("block"))
                     .agg(F.array_sort(F.collect_list(F.struct("place", "initial", "fault", "copies"))).alias("entries"))
                     .select("conv_id", F.col("entries")[0]["place"].alias("first"), "entries"), "blocks")
    per = Window.partitionBy("conv_id")
    # the conversations of several blocks: a matrix a block, folded, then the states between them
    several = written(blocks.select("conv_id", "first").withColumn("n", F.count("*").over(per)).withColumn("end", F.max("first").over(per))
                      .filter("n > 1").select("first", (F.col("first") == F.col("end")).alias("is_last")), "several")
    of_several = blocks.join(several, "first", "left_semi")

    def folded(df: DataFrame, value: str) -> DataFrame:
        """The blocks of each conversation in order, with what each was reduced to."""
        return blocks.select("conv_id", "first").join(df, "first").groupBy("conv_id") \
            .agg(F.array_sort(F.collect_list(F.struct("first", value))).alias("blocks")).select("blocks")

    matrices = of_several.select("first", "entries").mapInArrow(_matrices, "first long, matrix array<long>")
    behind = written(folded(matrices, "matrix").mapInArrow(_checkpoints, "first long, behind array<long>"), "behind")
    exits = of_several.select("first", "entries").join(behind, "first").select("first", "entries", "behind") \
        .mapInArrow(_exits, "first long, exits array<int>")
    enter = written(folded(exits, "exits").mapInArrow(_entries, "first long, enter int"), "enter")
    ready = blocks.join(several, "first", "left").join(behind, "first", "left").join(enter, "first", "left").select(
        "entries", F.coalesce("behind", F.array(*[F.lit(x).cast("long") for x in END])).alias("behind"),
        F.coalesce("enter", F.lit(ENTER)).alias("enter"), F.coalesce("is_last", F.lit(True)).alias("is_last"))
    edits = written(ready.mapInArrow(_edited, "place long, edits string, roles array<string>, cost long"), "edits")

    # the messages that come out
    made = whole.select("conv_id", "place", "role", "text").join(edits, "place") \
        .select("conv_id", "place", "role", "text", F.posexplode(F.arrays_zip(F.split("edits", ""), "roles")).alias("part", "made")) \
        .select("conv_id", "place", "part", F.col("made")["0"].alias("edit"), F.col("made.roles").alias("new_role"), "role", "text") \
        .filter("edit NOT IN ('D', '')")
    turns = made.select("conv_id", "place", "part", F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")).alias("role"),
                        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"), "edit")

    # the report
    legal = lambda x, y: F.concat(x, y).isin("su", "ua", "au")
    inside = F.aggregate("entries", F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).cast("long").alias("n")), lambda s, e: F.struct(
        e["initial"].alias("prev"), (s["n"] + e["copies"] - 1 + F.when(s["prev"].isNull() | legal(s["prev"], e["initial"]), 0).otherwise(1)).alias("n")))
    ends = blocks.select("conv_id", "first", inside.alias("in"), F.col("entries")[0]["initial"].alias("head"))
    before_block = F.lag("in.prev").over(Window.partitionBy("conv_id").orderBy("first"))
    illegal = ends.withColumn("prev", before_block).groupBy("conv_id").agg(
        F.sum(F.col("in.n") + F.when(F.col("prev").isNull() | legal(F.col("prev"), F.col("head")), 0).otherwise(1)).alias("illegal"))
    faults = judged.groupBy("conv_id").agg(
        F.sum(F.when(F.col("fault") == BLANK, F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == BLANK, 0).when(F.col("fault") == DUPLICATE, F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == TRUNCATED, 1).otherwise(0)).alias("truncated"))
    gaps = judged.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("x")).groupBy("conv_id") \
        .agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    spoken = lambda value, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")
    audits = judged.select("conv_id", "place", block.alias("block")).join(edits, "place").groupBy("conv_id", "block") \
        .agg(spoken("edits", "place").alias("edits"), F.sum("cost").alias("cost")) \
        .groupBy("conv_id").agg(spoken("edits", "block").alias("audit"), F.sum("cost").alias("cost"))
    report = conversations.select("conv_id").distinct()
    for i, part in enumerate((faults, gaps, illegal, audits)):
        # the null conversation is one of its own
        part = part.withColumnRenamed("conv_id", f"_of{i}")
        report = report.join(part, F.col("conv_id").eqNullSafe(F.col(f"_of{i}")), "left").drop(f"_of{i}")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return Edits(turns, report.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                                      F.coalesce("audit", F.lit("")).alias("audit")))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the digest of each conversation's ``role:text``, joined by newlines.

    The digest of a conversation is one sequential function of its whole text:
    its rows are streamed, sorted, through one task, which keeps the digest's state only.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for b in batches:
            done = []
            for conv, said in zip(b.column(0).to_pylist(), b.column(1)):
                if state is None or conv != held:
                    if state is not None:
                        done.append((held, state.hexdigest()))
                    held, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(said.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], b.column(0).type), pa.array([d[1] for d in done], pa.string())],
                                             names=["conv_id", "repaired_sha256"])
            last_type = b.column(0).type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], last_type), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return turns.select("conv_id", F.concat("role", F.lit(":"), "text").cast("binary").alias("said"), "place", "part") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "place", "part").select("conv_id", "said") \
        .mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
