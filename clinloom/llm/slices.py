"""Small helpers of the operators: slices of Arrow batches, and names for working columns.

Batches are cut into slices of a few MB of text, so that a task's Python holds no more at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text in a slice, unless one row alone has more.
SLICE_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch], at: int, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in order, in slices of at most ``limit`` bytes of column ``at`` and at least one row."""
    limit = limit or SLICE_BYTES
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        i = 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(i, j - i)
            i = j


def private(df: DataFrame, *names: str) -> dict[str, str]:
    """A column name for each of ``names`` that ``df`` doesn't have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        out[name] = own
    return out
