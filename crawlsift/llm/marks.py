"""Sets of keys as a bitmap of fixed size: small enough to broadcast whatever the number of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from crawlsift.llm.storage import saving
from crawlsift.llm.words import mix

#: 2^26 bits, 8 MB. Where very many keys are marked it lets more strangers through, which cost time but no row.
BITS, BLOCK = 26, 1 << 13


def places(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64), 3) >> np.uint64(64 - BITS)).astype(np.int64)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for batch in batches:
        at = places(batch.column(0).to_numpy(zero_copy_only=False))
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield _blocks({i: b for i, b in enumerate(bits.reshape(-1, BLOCK)) if b.any()})


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(data, np.uint8)
            found[block] = part | found[block] if block in found else part
    yield _blocks(found)


def _blocks(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array(list(found), pa.int32()), "data": pa.array([b.tobytes() for b in found.values()], pa.binary())})


def marked(keys: DataFrame) -> Broadcast:
    """The bitmap of a table of one long column, united over partitions before it reaches the driver."""
    kind = "block int, data binary"
    bits = np.zeros(1 << (BITS - 3), np.uint8).reshape(-1, BLOCK)
    with saving(keys.sparkSession):
        rows = keys.mapInArrow(_partial, kind).repartition("block").mapInArrow(_union, kind).collect()
    for row in rows:
        bits[row.block] = np.frombuffer(row.data, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits.tobytes())


def among(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every marked key, and for a few others."""
    at = places(keys)
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
