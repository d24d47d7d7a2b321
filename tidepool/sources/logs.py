"""Log tail (S11): the last N lines in their original order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default number of lines.
DEFAULT_TAIL = 50


def tail(lines: DataFrame, ts: str, seq: str, n: int = DEFAULT_TAIL) -> DataFrame:
    """Last ``n`` rows by (ts, seq), returned oldest first.

    The newest-first ``limit`` plans as a per-task top-n and a merge of n
    rows per task; only those n rows are re-sorted.
    """
    last = lines.orderBy(F.desc(ts), F.desc(seq)).limit(n)
    return last.orderBy(F.asc(ts), F.asc(seq))
