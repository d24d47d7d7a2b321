"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ASCII letters, for lower-casing A-Z alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and leave every other character alone. Pure ASCII text
    takes the fast built-in; it gives the same result there."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def is_held_out(doc_id: Column) -> Column:
    """True for rows that no model learns from: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns whose name (any case) an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def shielded(df: DataFrame, keep: Iterable[str], added: Iterable[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` over the columns ``keep`` alone, the others packed in one column and put back
    afterwards: whatever they are named, no name that ``work`` uses inside can clash with them.
    The columns ``added`` come last; columns of ``df`` with their names are replaced."""
    plain = without(df, added)
    rest = [c for c in plain.columns if c not in keep]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    out = work(plain.select(*[f"`{c}`" for c in plain.columns if c in keep], packed.alias("_rest")))
    return out.select(*[F.col("_rest").getField(c).alias(c) if c in rest else F.col(f"`{c}`") for c in plain.columns], *added)


SLICE_BYTES = 4_000_000  # about what is worked on and sent back at a time


def runs_of(batches: Iterable[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of any size in runs of rows of about ``size`` bytes, one row at least."""
    for b in batches:
        step = max(1, b.num_rows * size // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def release() -> None:
    """Give back what a finished task held: workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    # numpy's arrays come from the C library, and glibc keeps what they leave until it is told
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives back what it held once it has ended."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def map_column(df: DataFrame, column: str, added: T.StructType,
               make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Append columns computed from one column, batch by batch, on the executors.

    ``make()`` runs once per task and returns a function from the column's
    Arrow array to the arrays of the ``added`` fields. All other columns pass
    through; a column with the name of an added one is replaced.
    """
    keep = without(df, [f.name for f in added.fields if f.name != column])
    out = T.StructType([f for f in keep.schema.fields
                        if f.name not in {a.name for a in added.fields}] + added.fields)
    names = out.names
    new = [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in runs_of(batches):
            made = dict(zip(new, work(b.column(b.schema.get_field_index(column)))))
            yield pa.RecordBatch.from_arrays(
                [made[n] if n in made else b.column(b.schema.get_field_index(n)) for n in names],
                names=names)
        work = made = b = None
        release()

    return keep.mapInArrow(run, out)


def in_parts(col: pa.Array, work: Callable[[list], list], chars: int = 300_000) -> list:
    """``work`` over the values of a text column, about ``chars`` characters at a
    time (one text at least), so memory does not follow the batch's size."""
    out, part, size = [], [], 0
    for t in col:
        part.append(t.as_py())
        size += len(part[-1] or "") + 1
        if size >= chars:
            out += work(part)
            part, size = [], 0
    return out + (work(part) if part else [])
