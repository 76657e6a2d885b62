"""Places in texts that equal strings agree on.

Each string of ``width`` bytes has an anchor: the place of the smallest hashed gram in it, the
leftmost of equal ones. Equal strings have their anchors at the same distance from their
starts, wherever they are. Neighbouring strings mostly share an anchor; a run is all consecutive
starts whose strings have the same one.

Strings may also be of words: an array of word hashes takes the place of the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from ledgerloom.llm.wordhash import prefix_hashes, span_hashes

GRAM_BYTES = 24
#: Words of a gram, where strings are of words
GRAM_WORDS = 12
PIECE_BYTES = 1 << 20
_PLACE_BITS = 28
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


class Runs(NamedTuple):
    text: np.ndarray  # number of the text
    low: np.ndarray  # first start, in the text
    high: np.ndarray  # last start
    anchor: np.ndarray
    gram: np.ndarray  # hash of the gram at the anchor
    whole: np.ndarray  # hash of all bytes of the run's strings, and where the anchor is in them


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by minima from block borders."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:count], forward[width - 1 : width - 1 + count])


def pieces(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, bytes before, bytes, offsets): a long text alone comes in overlapping pieces.

    Pieces overlap by one byte less than ``width``, so each string of that length starts in one.
    """
    if len(offsets) > 2 or len(data) <= PIECE_BYTES:
        yield 0, 0, data, offsets
        return
    for low in range(0, len(data), PIECE_BYTES):
        piece = data[low : low + PIECE_BYTES + width - 1]
        yield 0, low, piece, np.array([0, len(piece)], np.int64)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, width: int, gram: int = GRAM_BYTES) -> Runs:
    """Runs of all strings of ``width`` bytes (or word hashes) in the texts between ``offsets``."""
    n = len(data)
    if n < width:
        empty = np.zeros(0, np.int64)
        return Runs(*[empty] * 4, *[empty.astype(np.uint64)] * 2)
    assert n <= int(_PLACE), "callers pass texts in pieces"
    sums = prefix_hashes(data)
    at = np.arange(n - gram + 1)
    grams = span_hashes(sums, at, at + gram)
    keys = (grams & ~_PLACE) | at.astype(np.uint64)
    anchor = (sliding_minimum(keys, width - gram + 1) & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.arange(len(anchor))
    fits = start + width <= offsets[1:][text]
    opens = fits.copy()
    opens[1:] &= (anchor[1:] != anchor[:-1]) | ~fits[:-1]
    closes = fits.copy()
    closes[:-1] &= (anchor[1:] != anchor[:-1]) | ~fits[1:]
    low, high = np.flatnonzero(opens), np.flatnonzero(closes)
    place = anchor[low]
    whole = span_hashes(sums, low, high + width) ^ ((place - low).astype(np.uint64) << np.uint64(32))
    origin = offsets[:-1][text[low]]
    return Runs(text[low], low - origin, high - origin, place - origin, grams[place], whole)
