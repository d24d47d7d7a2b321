"""Postings of Arrow batches of documents; runs in the tasks that write a segment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words that are counted at once.
RUN = 8_000_000


def runs(sizes: np.ndarray):
    """Consecutive slices (from, to) of ``RUN`` bytes or, for a longer one, of one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")))
        yield at, to
        at = to


def blocks(batches):
    """Rows (_id, field, words) as blocks (field, term, ids, tfs, dls): a row for each term of
    a run of documents, by field and term."""
    for batch in batches:
        for at, to in runs(pc.binary_length(batch["words"]).to_numpy(zero_copy_only=False)):
            part = batch.slice(at, to - at)
            for field in sorted(pc.unique(part["field"]).to_pylist()):
                yield of_field(part.filter(pc.equal(part["field"], field)), field)


def of_field(rows: pa.RecordBatch, field: str) -> pa.RecordBatch:
    words = pc.split_pattern(rows["words"], " ")
    dl = pc.list_value_length(words).to_numpy()
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    # a word of a document as one number: equal words come together, and their documents in order
    pairs, tf = np.unique(place[coded.indices.to_numpy()] * len(rows) + np.repeat(np.arange(len(rows)), dl), return_counts=True)
    term, doc = np.divmod(pairs, len(rows))
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = pa.array(np.append(starts, len(term)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, x) for x in (rows["_id"].take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(dl[doc], pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([field] * len(starts), pa.string()), coded.dictionary.take(order), *lists], ["field", "term", "ids", "tfs", "dls"])
