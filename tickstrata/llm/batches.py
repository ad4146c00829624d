"""Arrow batches in slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SLICE = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows: what Python makes of their texts at once stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
