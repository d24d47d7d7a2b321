"""Worker-side code of the JSON-array export (runs inside ``mapInPandas``).

This module is pickled by value, so executors need no copy of the package:
keep it small and free of imports from ``tidepool``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def array_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frame one partition's JSON rows as a single array: '[' row, row ... ']'.

    Holds back one batch so it knows which row is the partition's last.
    """
    prev = None
    first = True
    for b in batches:
        if len(b) == 0:
            continue
        if prev is not None:
            yield frame(prev, first, last=False)
            first = False
        prev = b
    if prev is not None:
        yield frame(prev, first, last=True)


def frame(b: pd.DataFrame, first: bool, last: bool) -> pd.DataFrame:
    v = b["value"].astype(object).to_numpy(copy=True)
    v[:-1] = v[:-1] + ","
    v[-1] = v[-1] + ("]" if last else ",")
    if first:
        v[0] = "[" + v[0]
    return pd.DataFrame({"value": v})
