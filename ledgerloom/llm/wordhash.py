"""Words and bytes of many texts at once, as numpy arrays over their UTF-8 bytes.

Spark hands a task batches of rows; the helpers here work on slices of a batch that hold
about a megabyte of text, so that a task needs the same memory whatever the batch is.
One text longer than that forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def byte_class(outside: bytes | None = None, inside: bytes | None = None) -> np.ndarray:
    """A table of 256 booleans: bytes that belong to words."""
    table = np.ones(256, bool) if outside is not None else np.zeros(256, bool)
    listed = np.frombuffer(outside if outside is not None else inside, np.uint8)
    table[listed] = outside is None
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_class(outside=b" \t\n\x0b\x0c\r")
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = byte_class(outside=bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: A-Z to a-z, all else as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd numbers of 64 bits."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, kept by each Python worker."""

    def __init__(self) -> None:
        self.size = 0
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, SLICE_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = self._row(_BASE)
            self.down = self._row(inverse)
        return self.up[:n], self.down[:n]

    def _row(self, base: int) -> np.ndarray:
        row = np.full(self.size, base, np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)


_powers = _Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` gets the hash of any span of ``data``."""
    up, _ = _powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of some texts: hashes in order, and where each text's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of length texts + 1


def find_words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> Words:
    """Words of the texts that lie in ``data`` between ``offsets``; no word crosses texts."""
    inside = members[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    opens[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    while done < len(starts):  # sums over a slice at a time; a longer word gets its own
        origin = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, origin + SLICE_BYTES, "right")))
        sums = prefix_hashes(data[origin : ends[upto - 1]])
        hashes[done:upto] = span_hashes(sums, starts[done:upto] - origin, ends[done:upto] - origin)
        done = upto
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each ``width`` consecutive words."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for j, c in enumerate(constants(width, seed)):
        total += hashes[j : j + count] * c
    return mix(total)


def text_slices(
    column: pa.Array, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of a string column; null is empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = pa.large_binary()
    column = column.cast(kind)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    raw = column.buffers()[2]
    whole = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        data = whole[bounds[row] : bounds[stop]]
        yield row, stop, data, bounds[row : stop + 1] - bounds[row]
        row = stop
