"""Reproducible global shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n-1 in the order of ``order_by``. A keyed Feistel network permutes the smallest even-bit domain that
holds n; a value beyond n-1 is permuted again until it falls inside (cycle walking), so the whole is a permutation of the row numbers.
Position p goes to shard ``p % shards`` and slot ``p // shards``: counts differ by one at most, slots
have no gaps, and the place of any row, or the row at any place, is computed from (n, shards, seed) alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import free_name, new_path, number_rows

ROUNDS = 6
_M1, _M2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class FeistelPermutation:
    """A permutation of range(n) that depends on n and the seed only."""

    def __init__(self, n: int, seed: int = 0, rounds: int = ROUNDS):
        if n < 0:
            raise ValueError("n is negative")
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        with np.errstate(over="ignore"):
            self.keys = [_mix(np.array([seed % 2**64], dtype=np.uint64) + _GOLDEN * np.uint64(r + 1)) for r in range(rounds)]

    def _once(self, x: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        with np.errstate(over="ignore"):
            for k in keys:
                left, right = right, left ^ (_mix(right * _GOLDEN + k) & self.mask)
        return (right << self.half) | left  # the halves swap, so that reversed keys undo it

    def _walk(self, x: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        out = self._once(x.astype(np.uint64), keys)
        beyond = np.flatnonzero(out >= np.uint64(self.n))
        while len(beyond):
            out[beyond] = self._once(out[beyond], keys)
            beyond = beyond[out[beyond] >= np.uint64(self.n)]
        return out.astype(np.int64)

    def position(self, row: np.ndarray) -> np.ndarray:
        """Where each row number goes."""
        return self._walk(np.asarray(row), self.keys)

    def row(self, position: np.ndarray) -> np.ndarray:
        """Which row number lies at each position: the inverse."""
        return self._walk(np.asarray(position), self.keys[::-1])

    def place(self, row: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of each row number."""
        p = self.position(row)
        return p % shards, p // shards

    def row_at(self, shard: int, slot: int, shards: int) -> int:
        """The row number at a slot of a shard."""
        return int(self.row(np.array([slot * shards + shard]))[0])


def shard_rows(df: DataFrame, order_by: list[str], shards: int = 24, seed: int = 0) -> DataFrame:
    """All columns of ``df`` with ``row_number``, ``shard`` and ``slot``.

    Null keys come first, rows that tie in every key of ``order_by`` are numbered in an arbitrary order (name all columns
    that tell rows apart), repeated rows each have a place, and an empty table gives no rows. Columns called
    row_number, shard or slot in ``df`` are an error.
    """
    if clash := {"row_number", "shard", "slot"} & set(df.columns):
        raise ValueError(f"columns would clash: {sorted(clash)}")
    numbered, n = number_rows(df, order_by)

    @F.pandas_udf("shard int, slot long")
    def place(rows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        perm = FeistelPermutation(n, seed)
        for r in rows:
            shard, slot = perm.place(r.to_numpy(), shards)
            yield pd.DataFrame({"shard": shard.astype(np.int32), "slot": slot})

    at = free_name(numbered, "place")
    return numbered.withColumn(at, place("row_number")).withColumns({"shard": F.col(f"{at}.shard"), "slot": F.col(f"{at}.slot")}).drop(at)


def write_shards(df: DataFrame, path: str | None = None) -> str:
    """Write rows that have a shard and slot as one folder a shard, each file in slot order."""
    path = path or new_path(df.sparkSession, "shards")
    df.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
