"""Whole groups of ordered rows inside a task, a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Rows of whole groups that a task gathers before it works them out; at least one group.
GATHERED = 1 << 15


def group_numbers(part: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Numbers of the groups of rows that are ordered by ``keys``; null is a key like others."""
    new = np.zeros(part.num_rows, bool)
    for k in keys:
        codes = np.asarray(part.column(k).combine_chunks().dictionary_encode("encode").indices)
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def by_groups(keys: Sequence[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], most: int | None = None) -> Callable:
    """A function for mapInArrow on rows ordered by ``keys``: ``work`` gets tables of whole groups and the groups' numbers."""
    most = most or GATHERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, enough = [], 0, most
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < enough:
                continue
            part = pa.Table.from_batches(held).combine_chunks()
            groups = group_numbers(part, keys)
            whole = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
            if whole:
                yield from work(part.slice(0, whole), groups[:whole])
            held, count = part.slice(whole).to_batches(), part.num_rows - whole
            enough = max(most, 2 * count)
        if count:
            part = pa.Table.from_batches(held).combine_chunks()
            yield from work(part, group_numbers(part, keys))

    return run
