"""Exact top-k inner products over a bit-sliced index.

Rows are cut into blocks. In a block each attribute is stored as bitmaps, one
per bit (its slices), the lowest ``drop`` bits left off. A query's scores are
added up by bitmap arithmetic (three bitmaps of one place become a sum and a
carry), the k-th best value is read off from the most significant slice down,
and the rows that the dropped bits leave undecided at that boundary are scored
exactly from their whole numbers. Each query meets every block; the blocks'
best rows are merged.

The index, a row per block with its slices, is written once to the shared
folder; every query block reads it from there.

Results by case: vectors that are null or hold null or non-finite components
take no part; vectors are compared with those of the same length (empty ones
score 0); only a row itself is never its own answer, another row of the same id
may be; repeated query rows are answered each, repeated candidates stay; ties go
to the smaller id; fewer candidates than k give all; an empty table gives no
rows. Components beyond 2**27 are scored without slices, in whole numbers of any
size; only a score among the best that is beyond 64 bits is an error.
"""

from __future__ import annotations

import heapq
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_path

BLOCK_ROWS = 8192
BLOCK_CELLS = 1 << 22  # components of a block's rows
WIDEST = 1 << 27       # components beyond have no slices
BLOCK_QUERIES = 1024
DROP = 2


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def add_up(numbers: np.ndarray) -> np.ndarray:
    """Sum of many sliced numbers: (bit, number, word) -> (bit, word)."""
    while numbers.shape[1] > 2:
        m = numbers.shape[1] // 3
        a, b, c = numbers[:, 0:3 * m:3], numbers[:, 1:3 * m:3], numbers[:, 2:3 * m:3]
        half = a ^ b
        blank = np.zeros((1, m, numbers.shape[2]), numbers.dtype)
        carry = np.concatenate([blank, (a & b) | (half & c)])
        rest = numbers[:, 3 * m:]
        parts = [np.concatenate([half ^ c, blank]), carry,
                 np.concatenate([rest, np.zeros((1, *rest.shape[1:]), rest.dtype)])]
        numbers = np.concatenate(parts, axis=1)
        if not numbers[-1].any():
            numbers = numbers[:-1]
    if numbers.shape[1] == 1:
        return numbers[:, 0]
    out, carry = np.empty((numbers.shape[0] + 1, numbers.shape[2]), numbers.dtype), np.zeros(numbers.shape[2], numbers.dtype)
    for i, (a, b) in enumerate(zip(numbers[:, 0], numbers[:, 1])):
        out[i] = a ^ b ^ carry
        carry = (a & b) | (carry & (a ^ b))
    out[-1] = carry
    return out


class Block:
    """The slices of one block of rows."""

    def __init__(self, vectors: np.ndarray, drop: int = DROP):
        self.vectors, self.rows = vectors, len(vectors)
        self.low = vectors.min(0)
        offset = vectors - self.low
        bits = int(offset.max(initial=0)).bit_length()
        self.drop = min(drop, max(0, bits - 1))
        self.bits = max(1, bits - self.drop)
        kept = (offset >> self.drop).T  # attribute, row
        words = -(-self.rows // 64)
        planes = np.zeros((self.bits, vectors.shape[1], words * 64), np.uint8)
        for b in range(self.bits):
            planes[b, :, :self.rows] = (kept >> b) & 1
        self.slices = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)
        here = np.zeros(words * 64, np.uint8)
        here[:self.rows] = 1
        self.here = np.packbits(here, bitorder="little").view(np.uint64)

    def packed(self) -> dict:
        return {"low": self.low.tobytes(), "bits": self.bits, "drop": self.drop, "slices": self.slices.tobytes(), "here": self.here.tobytes()}

    @classmethod
    def unpacked(cls, vectors: np.ndarray, stored) -> Block:
        block = cls.__new__(cls)
        block.vectors, block.rows, block.bits, block.drop = vectors, len(vectors), int(stored["bits"]), int(stored["drop"])
        block.low = np.frombuffer(stored["low"], np.int64)
        block.here = np.frombuffer(stored["here"], np.uint64)
        block.slices = np.frombuffer(stored["slices"], np.uint64).reshape(block.bits, vectors.shape[1], len(block.here))
        return block

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Slices of sum(|q| * x'), x' being x's kept bits, inverted where q < 0."""
        size = np.abs(query)
        signed = np.where((query < 0)[None, :, None], ~self.slices, self.slices)
        sums = []
        for j in range(int(size.max(initial=0)).bit_length()):
            on = (size >> j) & 1 == 1
            if on.any():
                sums.append((j, add_up(signed[:, on])))
        if not sums:
            return np.zeros((1, len(self.here)), np.uint64)
        tall = max(j + len(x) for j, x in sums)
        stack = np.zeros((tall, len(sums), len(self.here)), np.uint64)
        for i, (j, x) in enumerate(sums):
            stack[j:j + len(x), i] = x
        return add_up(stack)

    def best(self, query: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Rows that hold the k best exact scores, ties included; ``own`` rows never count."""
        total, alive = self.scores(query), self.here.copy()
        for r in own:
            alive[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        left = int(np.bitwise_count(alive).sum())
        if not left:
            return np.zeros(0, np.int64)
        want, kth, pool = min(k, left), 0, alive
        for b in range(len(total) - 1, -1, -1):
            top = pool & total[b]
            n = int(np.bitwise_count(top).sum())
            if n >= want:
                pool, kth = top, kth | 1 << b
            else:
                want, pool = want - n, pool & ~total[b]
        # the dropped bits move a score by less than this many units of the kept ones
        slack = -(-((1 << self.drop) - 1) * int(np.abs(query).sum()) // (1 << self.drop))
        least = max(0, kth - slack)
        above, equal = np.zeros_like(alive), alive
        for b in range(len(total) - 1, -1, -1):
            if least >> b & 1:
                equal = equal & total[b]
            else:
                above, equal = above | (equal & total[b]), equal & ~total[b]
        flags = np.unpackbits((above | equal).view(np.uint8), bitorder="little")
        return np.nonzero(flags)[0]


INDEX = "rb int, d int, row_ids binary, vec_ids binary, vectors binary, low binary, bits int, drop int, slices binary, here binary"
FOUND = "query_row long, query_id long, vec_id long, score long"


def _is_wide(x: np.ndarray) -> bool:
    return max(int(x.max(initial=0)), -int(x.min(initial=0))) > WIDEST


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["v"].tolist(), np.int64).reshape(len(rows), int(rows["d"].iloc[0]))


def index_block(rows: pd.DataFrame) -> pd.DataFrame:
    """One block's rows (rb, d, row, vec_id, v) as one row of the index; without slices
    where the vectors are empty or hold components too wide for them."""
    x = _matrix(rows)
    made = {"low": b"", "bits": 0, "drop": 0, "slices": b"", "here": b""}
    if x.shape[1] and not _is_wide(x):
        made = Block(x).packed()
    return pd.DataFrame([{"rb": rows["rb"].iloc[0], "d": rows["d"].iloc[0], "row_ids": rows["row"].to_numpy(np.int64).tobytes(),
                          "vec_ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "vectors": x.tobytes(), **made}])


def _search_wide(queries: pd.DataFrame, q: np.ndarray, row_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[pd.DataFrame]:
    """The same for a block with components too wide for the slices: every row scored in
    whole numbers of any size. Only a score among the best that is no long is an error."""
    wide, out = x.astype(object), []
    for row, qid, one in zip(queries["row"].tolist(), queries["vec_id"].tolist(), q.astype(object)):
        scored = heapq.nsmallest(k, ((-sum(map(operator.mul, v, one)), i) for v, i, r in zip(wide, ids.tolist(), row_ids.tolist()) if r != row))
        if any(not -1 << 63 <= -s < 1 << 63 for s, _ in scored):
            raise ValueError("a score beyond 64 bits")
        out.append(pd.DataFrame({"query_row": row, "query_id": qid, "vec_id": [i for _, i in scored], "score": [-s for s, _ in scored]}, dtype="int64"))
    return out


def search_block(queries: pd.DataFrame, index: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one block, a row of the index, for each query (row, vec_id, v, d)."""
    out = [pd.DataFrame({c.split()[0]: pd.Series([], dtype="int64") for c in FOUND.split(", ")})]
    if not len(queries) or not len(index):
        return out[0]
    stored, q = index.iloc[0], _matrix(queries)
    row_ids, ids = np.frombuffer(stored["row_ids"], np.int64), np.frombuffer(stored["vec_ids"], np.int64)
    x = np.frombuffer(stored["vectors"], np.int64).reshape(len(ids), q.shape[1])
    if q.shape[1] and (not stored["bits"] or _is_wide(q)):
        return pd.concat(_search_wide(queries, q, row_ids, ids, x, k))
    block = Block.unpacked(x, stored) if q.shape[1] else None
    place = {r: i for i, r in enumerate(row_ids.tolist())}
    for row, qid, one in zip(queries["row"].tolist(), queries["vec_id"].tolist(), q):
        own = np.array([place[row]] if row in place else [], np.int64)
        at = np.setdiff1d(np.arange(len(ids)), own) if block is None else block.best(one, k, own)
        exact = x[at] @ one
        order = np.lexsort((ids[at], -exact))[:k]
        out.append(pd.DataFrame({"query_row": row, "query_id": qid, "vec_id": ids[at][order], "score": exact[order]}))
    return pd.concat(out)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query row.

    ``vectors``: vec_id, embedding. Queries and rows are dealt to blocks of
    bounded size; every (query block, row block) cell is one small task.
    """
    spark, staged = vectors.sparkSession, work_path(vectors.sparkSession, "bitslice")
    vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("v"), is_query.alias("q"),
        F.monotonically_increasing_id().alias("row")).withColumn("d", F.size("v")).write.parquet(f"{staged}/rows")
    base = spark.read.parquet(f"{staged}/rows")  # written, so that a row keeps its number
    n, m = base.agg(F.count("*"), F.count_if("q")).first()
    query_blocks = max(1, -(-m // BLOCK_QUERIES))
    # long vectors take blocks of fewer rows
    row_blocks = F.greatest(F.lit(1), F.ceil(F.lit(n) / F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_CELLS) / F.greatest("d", F.lit(1)))))))
    rows = base.select("row", "vec_id", "v", "d", F.pmod(F.xxhash64("row"), row_blocks).cast("int").alias("rb"))
    rows.groupBy("rb", "d").applyInPandas(index_block, INDEX).write.parquet(f"{staged}/index")
    index = spark.read.parquet(f"{staged}/index").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = base.filter("q").select("row", "vec_id", "v", "d", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int").alias("qb")) \
        .withColumn("rb", F.explode(F.sequence(F.lit(0), (row_blocks - 1).cast("int"))))
    cell = ["rb", "qb", "d"]
    found = asked.groupBy(*cell).cogroup(index.groupBy(*cell)).applyInPandas(lambda a, b: search_block(a, b, k), FOUND)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
