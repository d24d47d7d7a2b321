"""N-gram Jaccard join over count vectors.

A document is the set of its word shingles. Hashing the shingles into groups
turns the set into a point, its counts per group. Two sets share at most the
sum of the smaller counts of each group, so points whose sum is too small
cannot be linked.

The points are indexed as an R-tree in two parts.

* Top: sets of size n can differ in r = (1 - t) / (1 + t) * (sizes) shingles
  at most. Bands of similar sizes use r + slack groups, so linked sets have at
  least ``slack`` groups with equal counts of equal sub-groups (a group is
  split into 65,536 sub-groups; the sparse sub-group counts are the group's
  coordinates). A cell of the top level holds the points that agree in one
  group's coordinates; a point lies in one cell per group. No link is lost.
* Below: the points of a cell are packed into leaves with bounding boxes; pairs
  of boxes, then of points, whose summed coordinate minima are too small are
  pruned. A point has a coordinate or two for each shingle; points of different
  lengths, and the boxes, are compared after folding to the shorter length.

Only cells of several points count from there on. They are visited twice. First each point is paired with its cell's first
point only; verified pairs give provisional components. Then cells that still
hold several components give the pairs across them, through the tree. So
groups of copies and near copies cost one pair per member, yet every link
between different components is tried. The tree is walked twice: once to drop
the points that have no partner left in a cell, which needs their counts only,
and once to give the pairs of the others, which also needs the first of a set's
cells, so that a pair is mostly given once. What is sent to every cell of a set
is kept short: its point folded to a few counts a coordinate. Pairs are verified
on the whole sets.

Disk: a step's shuffle files go when it is written, and a table when the last
step that reads it is; of the work only what the lazy result reads stays.

Sets are known by 64-bit hashes of shingles and of sets. Results by case: null
and empty texts have no shingles, no links and themselves as component;
repeated rows and ids are one group; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove, work_path, written
from .common import in_parts, releasing, runs_of
from .components import components
from .shingles import mix, shingle_sets

BOUND_GROUPS = 64  # fewest coordinates of a point below the top level, and those of the boxes
MOST_GROUPS = 1024 # most coordinates in a walk
LEAF = 32          # points in a leaf
CELL_ROWS = 2048   # points of a cell, or of two parts of one, in one walk, about
SLICE = 500_000    # characters or cells that a worker holds at a time, besides one text's
SLICE_ROWS = 2_000 # rows that it holds at a time
SEEN = 200_000     # sets that a task remembers, so that copies are sent once
BAND_BITS = 3      # bits of a cell that tell its band from its neighbours
CELL_BYTES = 6     # of a cell's hash, its lowest ones: sets of one cell by chance are pairs too many, which are verified
FOLDED = 4         # a point is folded to its length by this for the walks, not below
WALK_GROUPS = 512  # coordinates
EARLIER = 128      # most cells of a set that a row lists
BROADCAST_ROWS = 200_000  # most row digests that are sent to every executor
RATIO = 5, 4       # sizes in a band: from n to below n * 5 / 4


def bands(limit: int) -> np.ndarray:
    """First sizes of the bands up to ``limit``."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, -(-out[-1] * RATIO[0] // RATIO[1])))
    return np.array(out)


def cells(hashes: np.ndarray, num: int, den: int, edges: np.ndarray) -> np.ndarray:
    """The cells of a set: in its own band, and in those bands where a larger
    set that it may be linked with lies. A cell's lowest bits are those of its band's number."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    first = int(np.searchsorted(edges, n, side="right")) - 1
    last = int(np.searchsorted(edges, n * den // num, side="right")) - 1
    sub, where, out = mix(hashes & np.uint64(0xFFFF)), hashes >> np.uint64(20), []
    for band in range(first, last + 1):
        # two sets that are linked, the larger in this band, differ in r shingles at most
        r = (den - num) * 2 * (int(edges[band + 1]) - 1) // (den + num)
        slack = 3 + r // 80
        groups = r + slack
        at = (where % np.uint64(groups)).astype(np.int64)
        coordinates = np.zeros(groups, np.uint64)
        np.add.at(coordinates, at, sub)
        filled = np.bincount(at, minlength=groups) > 0
        # an empty group is a cell only for sets with so many of them that a
        # linked set might agree in empty groups alone
        keep = np.flatnonzero(filled if groups - int(filled.sum()) < slack else np.ones(groups, bool))
        cell = mix(coordinates[keep] + mix(keep.astype(np.uint64) + np.uint64(band << 32)))
        cell = cell & np.uint64((1 << 8 * CELL_BYTES) - 1 - BAND_BITS) | np.uint64(band & BAND_BITS)
        out.append(cell)
    return np.concatenate(out)


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def point(hashes: np.ndarray) -> np.ndarray:
    """Counts per group, a byte each; the number of groups is the first power of two from the
    set's size up, doubled for as long as a count needs more than a byte."""
    groups = max(BOUND_GROUPS, 1 << max(0, len(hashes) - 1).bit_length())
    while True:
        counts = np.bincount(((hashes >> np.uint64(8)) % np.uint64(groups)).astype(np.int64), minlength=groups)
        if counts.max() < 256:
            return counts.astype(np.uint8)
        groups *= 2


def pack(p: np.ndarray) -> bytes:
    """A point as it is stored and shuffled: the counts are small, so deflated."""
    return zlib.compress(p.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint8)


def pack_cells(cell: np.ndarray) -> bytes:
    return cell.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CELL_BYTES].tobytes()


def unpack_cells(raw: pa.BinaryArray) -> np.ndarray:
    """The cells of all rows."""
    packed = np.frombuffer(b"".join(v.as_buffer() for v in raw), np.uint8).reshape(-1, CELL_BYTES)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :CELL_BYTES] = packed
    return out.reshape(-1).view("<i8")


def fold(p: np.ndarray, groups: int) -> np.ndarray:
    return p if len(p) == groups else p.reshape(-1, groups).sum(0, dtype=np.int64)


def walked(p: np.ndarray) -> np.ndarray:
    """A point as it is sent to its cells: folded, as far as a count is a byte."""
    groups, short = len(p), min(MOST_GROUPS, max(WALK_GROUPS, len(p) // FOLDED))
    while groups > short and (half := fold(p, groups // 2)).max() < 256:
        p, groups = half.astype(np.uint8), groups // 2
    return p


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """The summed coordinate minima of two points."""
    groups = min(len(x), len(y))
    return int(np.minimum(fold(x, groups), fold(y, groups)).sum())


def enough(shared, a, b, num: int, den: int):
    """Whether ``shared`` common shingles of sets of sizes a and b reach the threshold."""
    return den * shared >= num * (a + b - shared)


def tree_pairs(points: np.ndarray, comp: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """Index pairs of different components that summed coordinate minima allow.

    Points are halved along the widest coordinate (or the size) down to leaves;
    a walk over pairs of nodes drops those whose boxes cannot hold a link.
    """
    size = points.sum(1, dtype=np.int64)
    out: list[np.ndarray] = []

    def build(rows: np.ndarray):
        held = points[rows]
        box = held.max(0), size[rows].min(), size[rows].max(), comp[rows[0]] if (comp[rows] == comp[rows[0]]).all() else None
        if len(rows) <= LEAF:
            return rows, box, None
        widest = int(np.append((box[0] - held.min(0)).astype(np.int64), box[2] - box[1]).argmax())
        order = rows[np.argsort(size[rows] if widest == points.shape[1] else held[:, widest], kind="stable")]
        del held
        return rows, box, (build(order[:len(order) // 2]), build(order[len(order) // 2:]))

    todo = [(root := build(np.arange(len(points))), root)]
    while todo:
        a, b = todo.pop()
        (top_a, low_a, high_a, one_a), (top_b, low_b, high_b, one_b) = a[1], b[1]
        if one_a is not None and one_a == one_b:
            continue
        # the threshold asks least of the smallest sets of both boxes
        if not enough(min(int(np.minimum(top_a, top_b).sum(dtype=np.int64)), high_a, high_b), low_a, low_b, num, den) or \
                den * high_a < num * low_b or den * high_b < num * low_a:
            continue
        if a[2] is None and b[2] is None:
            shared = np.minimum(points[a[0]][:, None], points[b[0]][None]).sum(2, dtype=np.int64)
            good = enough(shared, size[a[0]][:, None], size[b[0]][None], num, den) & (comp[a[0]][:, None] != comp[b[0]][None])
            i, j = np.nonzero(good)
            if len(i):
                out.append(np.stack([a[0][i], b[0][j]], 1))
        elif a is b:
            todo += [(a[2][0], a[2][0]), (a[2][1], a[2][1]), (a[2][0], a[2][1])]
        elif b[2] is None or (a[2] is not None and len(a[0]) >= len(b[0])):
            todo += [(a[2][0], b), (a[2][1], b)]
        else:
            todo += [(a, b[2][0]), (a, b[2][1])]
    return out


def _describe(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id, cells, point, walked. Within a task only the first copy
    of a set lists its cells, ``CELL_BYTES`` each: copies are one point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, seen = bands(1024), set()

        def work(texts: list) -> list:
            nonlocal edges
            out = []
            for h in shingle_sets(texts, k):
                if len(h) * den // num >= edges[-2]:
                    edges = bands(2 * len(h) * den // num)
                one = set_id(h)
                new = len(h) > 0 and one not in seen
                if new and len(seen) < SEEN:
                    seen.add(one)
                out.append((len(h), one, cells(h, num, den, edges) if new else None, point(h) if new else None))
            return out

        for b in (part for whole in batches for part in _slices(whole, 1)):
            rows = in_parts(b.column(1), work)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([None if r[2] is None else pack_cells(r[2]) for r in rows], pa.binary()),
                pa.array([None if r[3] is None else pack(r[3]) for r in rows], pa.binary()),
                pa.array([None if r[3] is None else pack(walked(r[3])) for r in rows], pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "set_id", "cells", "point", "walked"])

    return docs.mapInArrow(releasing(run), "doc_id long, text_key long, n_shingles long, set_id long, cells binary, point binary, walked binary")


def _slices(b: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of bounded size: a column's characters, bytes or list entries, and the rows."""
    col = b.column(column)
    sizes = (pc.binary_length(col) if pa.types.is_string(col.type) or pa.types.is_binary(col.type) else pc.list_value_length(col)) \
        .fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes + size // SLICE_ROWS) - 1) // size
    borders = np.flatnonzero(np.diff(run, prepend=-1))
    for start, stop in zip(borders.tolist(), [*borders[1:].tolist(), b.num_rows]):
        yield b.slice(start, stop - start)


def _listed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(cell, owner) of a batch of (set_id, cells)."""
    return unpack_cells(b.column(1)), np.repeat(b.column(0).to_numpy(zero_copy_only=False), pc.binary_length(b.column(1)).to_numpy() // CELL_BYTES)


def _batch(cell: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(owner)], names=["cell", "owner"])


@releasing
def _one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first point of each cell of a slice: a cell of very many points sends one per slice.
    A point's rows follow each other, so that its id is deflated in the shuffle."""
    for b in (part for whole in batches for part in _slices(whole, 1, SLICE * CELL_BYTES)):
        cell, owner = _listed(b)
        first = np.sort(np.unique(cell, return_index=True)[1])
        yield _batch(cell[first], owner[first])


@releasing
def _crowded_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of cells that hold several within a slice."""
    for b in (part for whole in batches for part in _slices(whole, 1, SLICE * CELL_BYTES)):
        cell, owner = _listed(b)
        _, at, n = np.unique(cell, return_inverse=True, return_counts=True)
        several = n[at] > 1
        yield _batch(cell[several], owner[several])


@releasing
def _crowded_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of cells that hold several; rows come sorted by cell."""
    held = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last row, or the last cell's first two
    for b in batches:
        cell, owner = (np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
        if not len(cell):
            continue
        start = np.concatenate([[True], cell[1:] != cell[:-1]])
        several = ~(start & np.concatenate([start[1:], [True]]))
        yield _batch(cell[several], owner[several])
        held = cell[-1:], owner[-1:]  # may come out twice; the rows are made distinct


def _bounded(num: int, den: int):
    """Keep the pairs (a, b, sizes, points) whose summed coordinate minima allow a link."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs_of(batches):
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (unpack(v.as_buffer()).astype(np.int64) for v in (x, y))
                good.append(enough(overlap_bound(x, y), int(x.sum()), int(y.sum()), num, den))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(2)], names=["a", "b"])

    return run


def _pairs_batch(pairs: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _folded(packed: pa.ChunkedArray) -> np.ndarray:
    """The points of a cell at one length, two bytes a count where these are enough."""
    points = [unpack(v.as_buffer()) for v in packed]
    groups = min(min(map(len, points)), MOST_GROUPS)
    few = max(map(len, points)) // groups * 255 < 1 << 16
    out = np.empty((len(points), groups), np.uint16 if few else np.int32)
    for i, p in enumerate(points):
        out[i] = fold(p, groups)
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The cells (or pairs of parts of one) of several components, each with its rows
    and points. Rows (cell, i, j, set_id, component, point, ...) come sorted by cell, i, j."""

    def split(rows: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray]]:
        key, comp = np.stack([rows.column(i).to_numpy() for i in range(3)], 1), rows.column(4).to_numpy()
        for at in np.split(np.arange(len(key)), np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1):
            if len(at) > 1 and (comp[at] != comp[at[0]]).any():
                part = rows.slice(int(at[0]), len(at))
                yield part, _folded(part.column(5))

    held: pa.Table | None = None
    for b in runs_of(batches):
        rows = pa.Table.from_batches([b])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        # the last cell may go on in the next batch
        key = np.stack([rows.column(i).to_numpy() for i in range(3)], 1)
        last = np.flatnonzero((key != key[-1]).any(1))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = rows.slice(cut)
        if cut:
            yield from split(rows.slice(0, cut))
    if held is not None:
        yield from split(held)


def _partnered(num: int, den: int):
    """The rows (cell, i, j, set_id, component) of the points that have a partner of another
    component in their cell: no more rows than come in, however many the pairs."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, points in _cells(batches):
            found = np.zeros(len(points), bool)
            for pairs in tree_pairs(points, part.column(4).to_numpy(), num, den):
                found[pairs.ravel()] = True
            if found.any():
                yield from part.select(range(5)).filter(pa.array(found)).combine_chunks().to_batches()

    return run


def _tree_pairs(num: int, den: int):
    """Pairs across components in each cell; a row's last column lists the smallest of the set's cells of
    the same band, if smaller than this one. A pair that meets in such a cell is left to that one."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, points in _cells(batches):
            ids, earlier = part.column(3).to_numpy(), [frozenset(v) for v in part.column(6).to_pylist()]
            for pairs in tree_pairs(points, part.column(4).to_numpy(), num, den):
                first = [earlier[x].isdisjoint(earlier[y]) for x, y in pairs.tolist()]
                yield _pairs_batch(ids[pairs[first]])

    return run


def _verify(num: int, den: int):
    """Keep the pairs (a, b, shingles of a, of b) that reach the threshold on the whole sets."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                good.append(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), num, den))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(2)], names=["a", "b"])

    return run


def _sets(k: int):
    """(set_id, shingles) of texts, each set once per task."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in (part for whole in batches for part in _slices(whole, 0)):
            ids, raw = [], []
            for h in in_parts(b.column(0), lambda texts: shingle_sets(texts, k)):
                one = set_id(h)
                if len(h) and one not in seen:
                    if len(seen) < SEEN:
                        seen.add(one)
                    ids.append(one)
                    raw.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary())], names=["set_id", "shingles"])

    return run


def _grouped(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, str]:
    """The points (a row per document: doc_id, text_key, set_id, n_shingles), the component of
    every set (set_id, doc_id: its smallest, component) and the folder they are in."""
    spark = docs.sparkSession
    path = work_path(spark, "jaccard")

    def table(df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{path}/{name}")

    def done(*names: str) -> None:
        remove(spark, *[f"{path}/{name}" for name in names])

    text_key = F.xxhash64("text")
    described = table(_describe(docs.select("doc_id", "text", text_key.alias("text_key")), k, num, den), "described")
    listed = described.filter(F.octet_length("cells") > 0).select("set_id", "cells")
    across = listed.mapInArrow(_one_each, "cell long, owner long").repartition("cell").sortWithinPartitions("cell") \
        .mapInArrow(_crowded_across, "cell long, owner long")
    crowd = table(across.unionByName(listed.mapInArrow(_crowded_here, "cell long, owner long")).distinct(), "crowd")
    points = table(described.select("doc_id", "text_key", "n_shingles", "set_id"), "points")
    shapes = table(described.filter(F.col("point").isNotNull()).select("set_id", "point", "walked").dropDuplicates(["set_id"]), "shapes")
    done("described")

    def joined(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(of.select(F.col("set_id").alias(side), F.col(column).alias(f"of_{side}")), side)
        return pairs.select("a", "b", "of_a", "of_b")

    def verified(likely: DataFrame, name: str) -> DataFrame:
        ids = likely.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        # a text for each set: the one with the smallest hash
        keys = table(points.select("set_id", "text_key").join(ids, "set_id", "left_semi").groupBy("set_id")
                     .agg(F.min("text_key").alias("text_key")).select("text_key").distinct(), f"{name}-keys")
        texts = docs.select("text", text_key.alias("text_key")).join(keys, "text_key", "left_semi").select("text")
        sets = table(texts.mapInArrow(_sets(k), "set_id long, shingles binary").dropDuplicates(["set_id"]), f"{name}-sets")
        links = table(joined(likely, sets, "shingles").mapInArrow(_verify(num, den), "a long, b long"), name)
        done(f"{name}-keys", f"{name}-sets")
        return links

    # first visit: each point of a cell with the cell's first point
    heads = crowd.groupBy("cell").agg(F.min("owner").alias("a"), F.count("*").alias("n"))
    headed = table(crowd.join(heads, "cell"), "headed")
    done("crowd")
    first = table(headed.filter("owner > a").select("a", F.col("owner").alias("b")).distinct(), "first")
    likely = table(joined(first, shapes, "point").mapInArrow(_bounded(num, den), "a long, b long"), "likely")
    links = verified(likely, "links1")
    part = components(links, f"{path}/components1").withColumnRenamed("node", "owner")
    # second visit: cells of three or more points that still hold several components
    inside = table(headed.filter("n > 2").select("cell", "owner").join(part, "owner", "left")
                   .withColumn("component", F.coalesce("component", "owner")), "inside")
    done("headed", "likely", "components1")
    open_cells = inside.groupBy("cell").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")) \
        .filter("low < high").select("cell", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts"))
    opened = table(inside.join(open_cells, "cell"), "opened")
    done("inside")
    keys = ["cell", "i", "j"]
    # a cell of many points is dealt out as pairs of its parts
    dealt = opened.withColumn("own", F.pmod(F.xxhash64("owner"), F.col("parts")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))) \
        .select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                F.col("owner").alias("set_id"), "component")
    short = shapes.select("set_id", F.col("walked").alias("point"))
    near = table(dealt.join(short, "set_id").select(*keys, "set_id", "component", "point")
                 .repartition(*keys).sortWithinPartitions(*keys)
                 .mapInArrow(_partnered(num, den), "cell long, i int, j int, set_id long, component long"), "near")
    done("opened")
    # what a set still brings to its cells: its point, and the list of the first of these cells
    brought = near.groupBy("set_id").agg(F.collect_set("cell").alias("cells")).join(short, "set_id")
    earlier = lambda c: (c < F.col("cell")) & (c.bitwiseAND(BAND_BITS) == F.col("cell").bitwiseAND(BAND_BITS))
    more = near.join(brought, "set_id").select(*keys, "set_id", "component", "point",
                                               F.slice(F.array_sort(F.filter("cells", earlier)), 1, EARLIER).alias("cells")) \
        .repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tree_pairs(num, den), "a long, b long")
    more = table(more.distinct().join(first, ["a", "b"], "left_anti"), "more")
    done("near", "first")
    likely = table(joined(more, shapes, "point").mapInArrow(_bounded(num, den), "a long, b long"), "likely2")
    done("more", "shapes")
    links = links.unionByName(verified(likely, "links2"))
    part = components(links, f"{path}/components2")
    done("links1", "links2", "likely2")

    # the smallest id of a set, then of a component
    sets = points.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    named = sets.join(part.withColumnRenamed("node", "set_id"), "set_id", "left") \
        .withColumn("component", F.coalesce("component", "set_id"))
    return points, named, path


def jaccard_join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id
    reachable by links ``den * intersection >= num * union`` of k-word shingle sets)."""
    points, named, path = _grouped(docs, k, num, den)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = written(named.join(least, "component").select("set_id", "component_id"), f"{path}/of_set")
    remove(docs.sparkSession, f"{path}/components2")
    return points.join(of_set, "set_id").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row of each component: the one with the smallest doc_id (null last), then row key.

    The row key is a digest of all columns, so it is the same whenever a row is
    read; of rows equal in all columns one is kept. Rows without words stay.
    """
    points, named, path = _grouped(docs, k, num, den)

    everything = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]),
                           {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                            "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    # the user's columns in one, so that none of their names can clash
    keyed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.unhex(F.sha2(everything, 256)).alias("_row"))
    # the rows by key, and the first one of each text
    rows = keyed.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")) \
        .select("_row", "doc_id", F.xxhash64("text").alias("text_key"))
    rows = written(rows.groupBy("_row", "doc_id", "text_key").agg(F.count("*").alias("n")), f"{path}/row_keys")
    best = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")
    of_text = rows.groupBy("text_key").agg(F.min(best).alias("best"))
    in_component = points.filter("n_shingles > 0").select("text_key", "set_id").distinct() \
        .join(named.select("set_id", "component"), "set_id").select("text_key", "component")
    first = written(of_text.join(in_component, "text_key").groupBy("component").agg(F.min("best").alias("best"))
                    .select("best._row"), f"{path}/kept")
    again = written(rows.filter("n > 1").join(first, "_row", "left_semi").select("_row"), f"{path}/again")
    apart = written(rows.join(first, "_row", "left_anti").select("_row").unionByName(again), f"{path}/apart")
    remove(docs.sparkSession, *[f"{path}/{name}" for name in ("points", "components2", "row_keys", "kept")])
    # where the digests are few, the documents are not dealt out to find them
    again, apart = (F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows for rows in (again, apart))
    one = keyed.join(again, "_row", "left_semi").dropDuplicates(["_row"])
    return keyed.join(apart, "_row", "left_anti").unionByName(one).select(*[F.col("_all").getField(c).alias(c) for c in docs.columns])
