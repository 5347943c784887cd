"""Exact top-k by inner product with vector-approximation files.

Vectors are cut into groups. A group's approximation file keeps for each vector the cell of each component: 2**BITS cells of equal
width between the group's least and largest value of that component. From cells alone the inner product with a query is bounded from both
sides. A group's cells are scanned first; then exact vectors are read in the order of their bounds until the k-th best
exact score beats every bound that is left. Each group gives its k best for each query, and the k best of those are the result.

Queries come in blocks. A block first visits one group, whose k-th best score is a floor for each of its queries: the result can't lie below it. Then every block visits every group with
its floors; the vectors stay where they are, and a group returns only rows that reach the floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BITS = 6
GROUP_ROWS = 16_384
LEAST_GROUPS = 24
QUERY_BLOCK = 256
_EXACT = 1 << 52
NO_FLOOR = -(1 << 63)


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """``id``, ``dim`` and ``ints``: each component x as floor(scale * x), little-endian, 4 bytes each or 8 where one needs it.

    Rows whose id or vector is null, or whose vector has a null or non-finite component, are left out. So are vectors so large that their product with themselves may pass 63 bits: dimension times
    the square of the largest component. The product of any two others fits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, ints = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                y = np.floor(scale * x)
                if len(y) and float(np.abs(y).max()) ** 2 * len(y) >= 2**63:
                    continue
                ids.append(i)
                dims.append(len(y))
                ints.append(y.astype("<i4" if not len(y) or np.abs(y).max() < 1 << 31 else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(ints, pa.binary())], ["id", "dim", "ints"])

    return vectors.select(F.col(f"`{id_col}`").cast("long"), f"`{vec_col}`").mapInArrow(run, "id long, dim int, ints binary")


def _matrix(rows: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, dtype="<i4" if len(r) == 4 * dim else "<i8").astype(np.int64) for r in rows]) if rows else np.zeros((0, dim), dtype=np.int64)


class ApproximationFile:
    """Cells and exact vectors of one group of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: int = BITS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low = self.vectors.min(axis=0)
        self.width = -(-(self.vectors.max(axis=0) - self.low + 1) // (1 << bits))
        self.cells = ((self.vectors - self.low) // np.maximum(self.width, 1)).astype(np.uint16)
        self.most = int(np.abs(self.vectors).max()) if self.vectors.size else 0

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and vector the most that their inner product can be, from the cells alone.

        A component lies from its cell's floor to floor + width - 1; the query's sign says which end counts.
        """
        floor = self.low + self.cells.astype(np.int64) * self.width
        slack = (np.maximum(queries, 0) * (self.width - 1)).sum(axis=1)
        return queries.astype(np.float64) @ floor.astype(np.float64).T + slack[:, None]

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The k best of the group for each query that reach its floor, its own id left out: (query, ids, scores), best first and ties to the smaller id."""
        floors = np.full(len(queries), NO_FLOOR) if floors is None else floors
        sure = queries.size > 0 and self.most * int(np.abs(queries).max()) * queries.shape[1] < _EXACT
        bounds = self.bounds(queries) if sure else None
        for r, (qid, q, floor) in enumerate(zip(query_ids.tolist(), queries, floors.tolist(), strict=True)):
            if not sure:  # beyond exact floating point: no bound to go by, so all vectors are read
                scores, seen = self.vectors @ q, np.arange(len(self.ids))
            else:
                bound, take = bounds[r], min(len(self.ids), 4 * k + 8)
                reach = np.flatnonzero(bound >= floor) if floor > NO_FLOOR else None
                while True:
                    if reach is not None and len(reach) <= take:  # nothing else can reach the floor
                        seen = reach
                        scores = self.vectors[seen] @ q
                        break
                    seen = np.argpartition(-bound, take - 1)[:take] if take < len(self.ids) else np.arange(len(self.ids))
                    scores = self.vectors[seen] @ q
                    own = self.ids[seen] != qid
                    if take == len(self.ids):
                        break
                    best = np.sort(scores[own])[::-1]
                    # certain once no vector left unread can reach the k-th score, ties included
                    if len(best) >= k and int((bound >= best[k - 1]).sum()) <= take:
                        break
                    take = min(len(self.ids), 4 * take)
            ok = (self.ids[seen] != qid) & (scores >= floor)
            ids, scores = self.ids[seen][ok], scores[ok]
            best = np.lexsort((ids, -scores))[:k]
            yield qid, ids[best], scores[best]


def _query_blocks(queries: DataFrame) -> DataFrame:
    """Queries of one dimension packed in rows of QUERY_BLOCK: their ids, floors and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_dim: dict[int, list[tuple[int, bytes, int]]] = {}
            for i, d, x, floor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_dim.setdefault(d, []).append((i, x, floor))
            for d, rows in by_dim.items():
                for at in range(0, len(rows), QUERY_BLOCK):
                    some = rows[at : at + QUERY_BLOCK]
                    q = _matrix([x for _, x, _ in some], d)
                    kind = "<i4" if not q.size or np.abs(q).max() < 1 << 31 else "<i8"
                    raw = b"".join(np.array([r[c] for r in some], dtype="<i8").tobytes() for c in (0, 2)) + q.astype(kind).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([len(some)], pa.int64()), pa.array([d], pa.int32()), pa.array([raw], pa.binary())], ["id", "dim", "ints"])

    return queries.select("id", "dim", "ints", "floor").mapInArrow(run, "id long, dim int, ints binary")


def _unpacked(n: int, dim: int, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, floors = np.frombuffer(raw, dtype="<i8", count=2 * n).reshape(2, n)
    wide = len(raw) - 16 * n == 8 * n * dim
    return ids, floors, np.frombuffer(raw, dtype="<i8" if wide else "<i4", offset=16 * n).astype(np.int64).reshape(n, dim)


def _visited(own: DataFrame, blocks: DataFrame, groups: int, k: int) -> DataFrame:
    """What the groups that each block (g, id, dim, ints) visits have for its queries: query_id, id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, files = None, {}, {}
        for batch in batches:
            for g, kind, i, d, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    group, held, files = g, {}, {}
                if kind == 0:  # a group's vectors come before the query blocks
                    held.setdefault(d, []).append((i, x))
                    continue
                if d not in held:
                    continue
                if d not in files:
                    files[d] = ApproximationFile(np.array([v for v, _ in held[d]], dtype=np.int64), _matrix([v for _, v in held[d]], d))
                ids, floors, q = _unpacked(i, d, x)
                found = [*files[d].top(ids, q, k, floors)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))], ["query_id", "id", "score"])

    rows = own.withColumn("kind", F.lit(0)).unionByName(blocks.withColumn("kind", F.lit(1))).select("g", "kind", "id", "dim", "ints")
    return rows.repartition(groups, "g").sortWithinPartitions("g", "kind").mapInArrow(run, "query_id long, id long, score long")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``id`` and ``score``: the k largest integer inner products of each query with the other rows.

    ``is_query`` is a condition on ``id_col``. Ties go to the smaller id; fewer candidates than k give fewer rows. Null ids and vectors that are null or hold
    null or non-finite components take no part; vectors of another length than the query's are no candidates for it. An
    id's own rows are never its candidates; where a query's id repeats, the smallest of its vectors is the query, and candidates that repeat
    count once a row. An empty table gives no rows; other columns are not read.
    """
    rows, _ = stage(integer_vectors(vectors, id_col, vec_col, scale), "vectors")
    queries = rows.select(F.col("id").alias(id_col), F.struct("dim", "ints").alias("_vector")).where(is_query).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min("_vector").alias("q")).select("id", "q.*")
    queries, _ = stage(queries, "queries")
    groups = max(LEAST_GROUPS, -(-rows.count() // GROUP_ROWS))
    own = rows.select(F.pmod(F.xxhash64("id", "ints"), F.lit(groups)).cast("int").alias("g"), "id", "dim", "ints")
    tasks = max(1, groups // 8)
    one = _query_blocks(queries.withColumn("floor", F.lit(NO_FLOOR)).coalesce(tasks)).withColumn("g", F.pmod(F.xxhash64("ints"), F.lit(groups)).cast("int"))
    floors = _visited(own, one, groups, k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    floors, _ = stage(floors.select("query_id", "least"), "floors")
    floored = queries.join(floors, F.col("id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("least", F.lit(NO_FLOOR)))
    blocks = _query_blocks(floored.coalesce(tasks)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return _visited(own, blocks, groups, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
