"""Arrow batches of sorted partitions as tables of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Tables of at least that many rows that end where a group of keys ends; the input is sorted by keys."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        other = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t[k].combine_chunks()
            other |= pc.not_equal(c, c[t.num_rows - 1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def by_chars(texts: list[str], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with at most that many characters together, or one text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
