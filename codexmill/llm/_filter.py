"""A filter of hashes: a bit map of fixed size, put together by ranges on the executors.

It says surely of a hash that it is not in the set, and maybe that it is. It only ever decides what is looked at more
closely, never a result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: 2^BITS bits are broadcast, 8 MB; ranges of them are put together apart from each other.
BITS, RANGES = 26, 32
_LOCAL = BITS - 5


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


class Filter:
    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def maybe(self, hashes: np.ndarray) -> np.ndarray:
        s = slots(hashes)
        return (self.bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0


def _collect(batches: Iterator[pa.RecordBatch], hashes) -> Iterator[pa.RecordBatch]:
    held, more, size = np.zeros(0, np.int64), [], 0
    for batch in batches:
        more.append(np.unique(slots(hashes(batch))))
        size += len(more[-1])
        if size > 1_000_000:
            held, more, size = np.unique(np.concatenate((held, *more))), [], 0
    held = np.unique(np.concatenate((held, *more)))
    cuts = np.searchsorted(held, np.arange(RANGES + 1) << _LOCAL)
    for r in np.flatnonzero(np.diff(cuts)):
        part = np.zeros(1 << _LOCAL, bool)
        part[held[cuts[r] : cuts[r + 1]] - (r << _LOCAL)] = True
        yield pa.record_batch({"r": pa.array([r], pa.int32()), "bits": pa.array([zlib.compress(np.packbits(part, bitorder="little").tobytes(), 1)], pa.binary())})


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union by range; each range is one row of at most 2^_LOCAL bits."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for r, b in zip(batch.column("r").to_pylist(), batch.column("bits"), strict=True):
            part = np.frombuffer(zlib.decompress(b.as_py()), np.uint8)
            held[r] = held[r] | part if r in held else part
    for r, part in held.items():
        yield pa.record_batch({"r": pa.array([r], pa.int32()), "bits": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})


def make(df: DataFrame, hashes) -> Filter:
    """The filter of hashes(batch), arrays of unsigned 64-bit numbers; the driver gets 2^BITS bits, whatever df holds."""
    schema = "r int, bits binary"
    parts = df.mapInArrow(lambda it: _collect(it, hashes), schema).repartition(8, "r").mapInArrow(_unite, schema)
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    step = 1 << (_LOCAL - 3)
    for row in parts.toLocalIterator():
        bits[row["r"] * step : (row["r"] + 1) * step] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return Filter(bits)
