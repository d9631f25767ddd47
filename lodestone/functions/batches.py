"""Batches of texts for Python, bounded by bytes: a batch of Spark's has up to 10,000 rows, however long."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of texts, and of what is made of them, that Python holds at once, or one longer row.
BATCH_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `size` bytes at most, or of one longer row."""
    size = BATCH_BYTES if size is None else size
    for batch in batches:
        stack = [batch]
        while stack:
            piece = stack.pop()
            if len(piece) > 1 and piece.nbytes > size:
                half = len(piece) // 2
                stack += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece
