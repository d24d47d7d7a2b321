"""Document-style queries over a table: filter, point lookup, count, projection,
top-k and the slow-operation report (Q02-Q07, Q10).

All are plain DataFrame compositions: filters and projections reach the
Parquet scan as pushed filters / a pruned read schema, and every ``limit``
after an ``orderBy`` plans as ``TakeOrderedAndProject`` (a per-task top-k
followed by a merge of k rows per task), never a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(field: Column | str, as_type: str = "double") -> Column:
    """A field as a number, NULL when missing or not numeric.

    Document stores never match a comparison on a missing or non-numeric
    value; ``try_cast`` gives the same through SQL NULL, where an ANSI
    ``cast`` would fail the query.
    """
    return _c(field).try_cast(as_type)


def find_all(docs: DataFrame) -> DataFrame:
    """Every document (``find()``)."""
    return docs


def find_gte(docs: DataFrame, field: str, value) -> DataFrame:
    """``{field: {$gte: value}}``."""
    return docs.filter(numeric(field) >= F.lit(value))


def find_gt(docs: DataFrame, field: str, value) -> DataFrame:
    """``{field: {$gt: value}}`` / ``findByFieldGreaterThan``."""
    return docs.filter(numeric(field) > F.lit(value))


def find_one(docs: DataFrame, field: str, value, order_by: str) -> DataFrame:
    """First match or nothing; ``order_by`` (a unique key) makes "first" stable."""
    return docs.filter(_c(field) == F.lit(value)).orderBy(F.asc(order_by)).limit(1)


def count_docs(docs: DataFrame, cond: Column | None = None,
               named: dict[str, Column | None] | None = None) -> DataFrame:
    """One row of counts: ``n`` for ``cond`` (all rows when ``None``), or one
    column per entry of ``named`` (name -> condition), all in a single scan.

    Planned as a partial count per task and one final merge.
    """
    named = named if named is not None else {"n": cond}
    return docs.agg(*[(F.count(F.lit(1)) if c is None else F.count_if(c)).alias(n)
                      for n, c in named.items()])


def project(docs: DataFrame, fields: Sequence[Column | str]) -> DataFrame:
    """Keep only ``fields``; dotted names reach into structs (``a.b``)."""
    return docs.select(*[_c(f) for f in fields])


def top_k(docs: DataFrame, sort_col: str, k: int, tie_col: str,
          descending: bool = True) -> DataFrame:
    """``find().sort({sort_col: -1}).limit(k)``: sort first, then limit.

    A document store applies the sort before the limit whatever order the
    calls are written in, so this is never "take k, then sort them". Missing
    values sort lowest, as in Spark's default null ordering.
    """
    key = F.desc(sort_col) if descending else F.asc(sort_col)
    return docs.orderBy(key, F.asc(tie_col)).limit(k)


# The profiler's slow-operation threshold (milliseconds) and
# the size of the report.
SLOW_MS = 100
SLOW_REPORT_ROWS = 10


def slow_ops(ops: DataFrame, millis: str = "millis", ts: str = "ts", tie_col: str = "op_id",
             threshold_ms: float = SLOW_MS, k: int = SLOW_REPORT_ROWS) -> DataFrame:
    """Operations strictly slower than the threshold, newest first, ``k`` rows."""
    return (ops.filter(numeric(millis) > F.lit(float(threshold_ms)))
            .orderBy(F.desc(ts), F.desc(tie_col)).limit(k))
