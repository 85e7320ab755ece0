"""Slices of Arrow batches, so that a Python worker holds few pages as objects whatever the size of its batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

ROWS, SIZE = 256, 1 << 20  # rows and bytes of text of a slice, at most


def slices(text: pa.Array, rows: int = ROWS, size: int = SIZE) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs with at most `rows` rows and `size` bytes of text, or one larger row."""
    first, held = 0, 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
        if at > first and (held + n > size or at - first == rows):
            yield first, at - first
            first, held = at, 0
        held += n
    if first < len(text):
        yield first, len(text) - first
