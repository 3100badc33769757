"""Rows of a Python stage as small Arrow batches, so that a worker's memory doesn't grow with what a batch of texts gives."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows, and characters and numbers in their strings and lists, that one batch holds at most, but for one row's own.
ROWS, CELLS = 1 << 13, 1 << 20


def in_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, cells = [], 0
    for row in rows:
        held.append(row)
        cells += sum(len(v) for v in row if isinstance(v, str | list))
        if len(held) >= ROWS or cells >= CELLS:
            yield _batch(held, schema)
            held, cells = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The first two columns, one row at a time."""
    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1), strict=True):
            yield a.as_py(), b.as_py()
