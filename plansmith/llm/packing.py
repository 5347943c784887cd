"""Cost-balanced packing of documents into training sequences.

A sequence costs ``linear * tokens + quadratic * sum of squared piece lengths`` (attention within a piece).
Documents are taken in windows of bounded token count. In a window, whole sequences are cut from documents that exceed
the capacity; the rest go in descending length, each to the lowest-cost sequence that still has
room for it. The window opens as few sequences as hold its tokens, so what fits nowhere whole is cut over the emptiest ones:
a window pads less than one sequence.

Windows never leave a task and no row is shuffled: each task reads its split once, holds one window, and names its
sequences by its partition and a counter, so a repeated task gives the same rows for the same split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import encoder, vocabulary_path

CAPACITY = 4096
LINEAR = 1.0
QUADRATIC = 1.0 / 8192
WINDOW_TOKENS = 2_000_000

PIECE_FIELDS = [("piece_start", "long"), ("piece_length", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("seq_offset", "long"), ("piece_ids", "binary")]


def piece_cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    """What a piece of n tokens costs to train on: linear layers and attention within the piece."""
    return linear * n + quadratic * n * n


def pack_window(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pack one window. Returns (document, start, length, sequence, offset) pieces, in order of sequence and offset, and the number of sequences.

    Documents of no tokens give no piece. Ties go to the earlier document and to the lower sequence number.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    seq, rest = 0, []
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            pieces.append((d, at, capacity, seq, 0))
            seq, at = seq + 1, at + capacity
        if n > at:
            rest.append((-(n - at), d, at))
    total = -sum(x[0] for x in rest)
    bins = -(-total // capacity)
    used, cost = [0] * bins, [0.0] * bins
    heap = [(0.0, b) for b in range(bins)]

    def put(b: int, d: int, at: int, n: int) -> None:
        pieces.append((d, at, n, seq + b, used[b]))
        used[b] += n
        cost[b] += piece_cost(n, linear, quadratic)

    for minus, d, at in sorted(rest):
        n, aside = -minus, []
        while heap and capacity - used[heap[0][1]] < n:
            aside.append(heapq.heappop(heap))
        if heap:
            _, b = heapq.heappop(heap)
            put(b, d, at, n)
            if used[b] < capacity:
                aside.append((cost[b], b))
        else:  # no sequence has room for all of it: fill those with most room first
            left: list[tuple[float, int]] = []
            for c, b in sorted(aside, key=lambda x: (used[x[1]], x[1])):
                if n:
                    k = min(n, capacity - used[b])
                    put(b, d, at, k)
                    at, n, c = at + k, n - k, cost[b]
                if used[b] < capacity:
                    left.append((c, b))
            aside = left
        for x in aside:
            heapq.heappush(heap, x)
    pieces.sort(key=lambda p: (p[3], p[4]))
    return pieces, seq + bins


def pack_documents(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, capacity: int = CAPACITY, window_tokens: int = WINDOW_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, tokens_col: str | None = None) -> DataFrame:
    """One row per piece: the row's own columns but for the text, and where its tokens lie.

    ``piece_start`` and ``piece_length`` are the piece's place among the document's ids (``doc_tokens`` in all, the end id
    included), ``sequence_id`` and ``seq_offset`` its place in a sequence of at most ``capacity``
    tokens, and ``piece_ids`` its ids as little-endian unsigned 32-bit integers. A null or empty text is
    a document of its end id alone. Rows are documents of their own even where ids or texts repeat, so copies are
    packed once each. An empty table gives no rows. A clash of the row's columns with the names added here is an error.
    """
    path = vocabulary or vocabulary_path()
    keep = [f for f in docs.schema.fields if f.name not in (text_col, tokens_col)]
    if clash := {f.name for f in keep} & {n for n, _ in PIECE_FIELDS}:
        raise ValueError(f"columns would clash: {sorted(clash)}")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in keep])
    for name, kind in PIECE_FIELDS:
        schema = schema.add(name, kind)
    names = [f.name for f in keep]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        base, seqs = TaskContext.get().partitionId() << 32, 0
        rows: list[pa.RecordBatch] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seqs, held, rows, ids
            if not ids:
                return
            pieces, n = pack_window([len(x) // 4 for x in ids], capacity, linear, quadratic)
            table = pa.Table.from_batches(rows)
            for i in range(0, len(pieces), 2000):
                some = pieces[i : i + 2000]
                cols = [c.combine_chunks() for c in table.take(pa.array([p[0] for p in some])).columns]
                cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
                new = [
                    pa.array([p[1] for p in some], pa.int64()), pa.array([p[2] for p in some], pa.int64()), pa.array([len(ids[p[0]]) // 4 for p in some], pa.int64()),
                    pa.array([base + seqs + p[3] for p in some], pa.int64()), pa.array([p[4] for p in some], pa.int64()), pa.array([ids[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in some], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols + new, names + [n for n, _ in PIECE_FIELDS])
            seqs, held, rows, ids = seqs + n, 0, [], []

        for batch in batches:
            kept = batch.select(names) if names else None
            start = 0
            for k, x in enumerate(enc.encode(batch.column(text_col).to_pylist())):
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= window_tokens:
                    rows.append(kept.slice(start, k + 1 - start))
                    start = k + 1
                    yield from flush()
            if start < batch.num_rows:
                rows.append(kept.slice(start))
        yield from flush()

    if not names:
        raise ValueError("give at least one column that names the document")
    return docs.select(*[f"`{n}`" for n in names], f"`{text_col}`").mapInArrow(run, schema)
