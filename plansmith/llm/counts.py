"""Counts in tables of a fixed size, gathered from all rows: each task counts alone, slices of the tables are then added."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 14
SCHEMA = "at int, counts binary"


def _packed(x: np.ndarray) -> bytes:
    for kind in ("<u1", "<u2", "<u4"):
        if int(x.max()) <= np.iinfo(kind).max:
            return x.astype(kind).tobytes()
    return x.astype("<i8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype={SLICE: "<u1", 2 * SLICE: "<u2", 4 * SLICE: "<u4", 8 * SLICE: "<i8"}[len(raw)]).astype(np.int64)


def slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's table as rows (first cell, counts) of the slices that hold anything; its length is a multiple of SLICE."""
    for i in range(0, len(total), SLICE):
        part = total[i : i + SLICE]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_packed(part)], pa.binary())], ["at", "counts"])


def gather(parts: DataFrame, cells: int) -> np.ndarray:
    """The sum of all tasks' tables on the driver: ``cells`` numbers, whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _unpacked(raw)
                sums[at] = sums[at] + x if at in sums else x
        for at, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([_packed(x)], pa.binary())], ["at", "counts"])

    out = np.zeros(cells, dtype=np.int64)
    for r in parts.repartition("at").mapInArrow(add, SCHEMA).collect():
        out[r["at"] : r["at"] + SLICE] = _unpacked(bytes(r["counts"]))
    return out
