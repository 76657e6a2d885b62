"""Sets of hashes as bitmaps of a fixed size, small enough for every task to hold.

A bitmap only spares work: rows whose bit is missing are not in the set, the others still have
to be joined with it. It has the same size whatever the set is; a full one spares nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.wordhash import mix


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes.view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def bitmap(hashes: DataFrame, bits: int) -> bytes:
    """A bitmap of the one long column of ``hashes``; Spark sets the bits, ``bits / 8`` bytes return."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy(zero_copy_only=False), bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot >> 6), pa.array(np.left_shift(np.int64(1), slot & 63))],
                ["place", "bits"],
            )

    rows = (
        hashes.mapInArrow(slots, "place long, bits long")
        .groupBy("place")
        .agg(F.bit_or("bits").alias("bits"))
        .toPandas()
    )
    words = np.zeros(bits >> 6, np.int64)
    words[rows["place"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return words.tobytes()


def in_bitmap(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    words = np.frombuffer(packed, np.int64)
    slot = _slots(hashes, 64 * len(words))
    return (words[slot >> 6] >> (slot & 63)) & 1 == 1
