"""Tables in the shared folder and joins of checked size, and groups of rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from geolith.operators.tables import BROADCAST_ROWS, Stored, components, shared_dir, small

__all__ = ["BROADCAST_ROWS", "Stored", "components", "grouped", "shared_dir", "small"]


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first ``keys`` columns, over sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_pylist() for i in range(keys)]
        start = 0
        for i, key in enumerate(zip(*columns, strict=True)):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)
