"""Sorted hash arrays in the shared folder, written by tasks and mapped into memory by tasks.

The top bits of a 64-bit hash name a piece; a piece is a sorted array of hashes and one array for each value column.
The id of a hash is its place in all pieces together. Hashes are spread evenly, so pieces are of about equal size.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagetide.llm.shared import write_array

PER_PIECE = 1_000_000
U = np.uint64


def piece_bits(rows: int) -> int:
    return max(0, int(np.ceil(np.log2(max(rows, 1) / PER_PIECE))))


def piece_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


@dataclass
class HashArrays:
    """Reader of the arrays; files are opened in the worker that looks something up."""

    folder: str
    bits: int
    sizes: list[int]
    _open: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)

    def array(self, name: str, piece: int) -> np.ndarray:
        if (name, piece) not in self._open:
            self._open[name, piece] = np.load(os.path.join(self.folder, f"{name}-{piece}.npy"), mmap_mode="r")
        return self._open[name, piece]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the hashes, -1 for those that are not there."""
        out = np.full(len(hashes), -1, np.int64)
        starts, piece = self.starts, piece_of(hashes, self.bits)
        for p, at in by_piece(piece, 1 << self.bits):
            keys = self.array("hash", p) if self.sizes[p] else np.zeros(0, U)
            if not len(keys):
                continue
            h = hashes if at is None else hashes[at]
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = np.where(keys[i] == h, i + starts[p], -1)
            if at is None:
                return found
            out[at] = found
        return out

    def values(self, name: str, ids: np.ndarray) -> np.ndarray:
        """The value column for ids that are there."""
        starts = self.starts
        piece = np.searchsorted(starts, ids, "right") - 1
        out = None
        for p, at in by_piece(piece, len(self.sizes)):
            column = self.array(name, p)
            got = column[(ids if at is None else ids[at]) - starts[p]]
            if at is None:
                return got
            if out is None:
                out = np.zeros((len(ids), *column.shape[1:]), column.dtype)
            out[at] = got
        return np.zeros(0) if out is None else out


def by_piece(piece: np.ndarray, pieces: int):
    """(piece, places) for every piece that occurs; places is None where there is one piece for all."""
    if not len(piece):
        return
    if pieces == 1:
        yield 0, None
        return
    order = np.argsort(piece.astype(np.int16 if pieces < 2**15 else np.int64), kind="stable")
    ends = np.flatnonzero(np.diff(piece[order])) + 1
    for part in np.split(order, ends):
        yield int(piece[part[0]]), part


def write_pieces(rows: DataFrame, bits: int, folder: str, merge) -> HashArrays:
    """Write the pieces. `rows` has a column piece; merge(group) gives {name: array} with sorted "hash" among them."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        arrays = merge(group)
        for name, values in arrays.items():
            write_array(os.path.join(folder, f"{name}-{key[0].as_py()}.npy"), values)
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(arrays["hash"])], pa.int64())})

    sizes = [0] * (1 << bits)
    for piece, n in rows.groupBy("piece").applyInArrow(run, "piece long, n long").collect():
        sizes[piece] = n
    return HashArrays(folder, bits, sizes)
