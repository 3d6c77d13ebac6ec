"""A Bloom filter of fixed size, built by a distributed aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
PROBES = 3


def _probe(h: np.ndarray, i: int) -> np.ndarray:
    return ((h >> np.uint64(20 * i)) ^ (h << np.uint64(7 * i))) % np.uint64(BITS)


def build(hashes: DataFrame):
    """A broadcast filter of the one column of 64-bit hashes. It takes BITS / 8 bytes whatever the number of hashes; more hashes only let more others pass."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([_probe(h, i) for i in range(PROBES)])
            yield pa.RecordBatch.from_pydict({"cell": pa.array((at >> np.uint64(6)).astype(np.int64)), "bits": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    cells = hashes.mapInArrow(bits, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toPandas()  # BITS / 64 rows at most
    filled = np.zeros(BITS // 64, np.int64)
    filled[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
    return hashes.sparkSession.sparkContext.broadcast(filled.tobytes())


def passing(shared, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes that may be among those of the filter."""
    cells, at = np.frombuffer(shared.value, np.uint64), np.arange(len(h))
    for i in range(PROBES):
        bit = _probe(h[at], i)
        at = at[(cells[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0]
    return at
