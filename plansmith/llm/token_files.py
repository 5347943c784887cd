"""Token files: documents' ids in ascending document order, compressed by a static range asymmetric numeral system.

One frequency table, counted over all documents, serves every block. A row of the block table is a chunk: whole documents one after the other,
their ids cut into blocks of ``BLOCK`` tokens. A block is coded by itself on ``LANES`` interleaved lanes (token i goes to
lane i mod LANES), each a 64-bit state that gives off 32-bit words. Every ``CHECKPOINT`` steps the states and the place in the
words are kept, so that stretches of a block decode side by side; each block has the CRC-32 of its tokens.

Layout of a file set: ``<path>/table`` (token, frequency; frequencies add up to 2**SCALE) and ``<path>/blocks``, both
Parquet written by Spark, so that commits are atomic and any store that Spark reaches will do. ``data`` of a chunk, little-endian:
    4 bytes  magic "PSR1"           u32  tokens            u32  number of blocks
    per block: u32 tokens, u32 words, u32 CRC-32 of the tokens as u32 integers
    per block: for each checkpoint, LANES u64 states and one u32 count of the words before it
    per block: its words, u32
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, new_path, stage
from .tokens import encoder, vocabulary_path

SCALE = 20
LANES = 4
BLOCK = 8192
CHECKPOINT = 512
MAGIC = b"PSR1"
CHUNK_TOKENS = 131_072
BATCH_TOKENS = 2_000_000
PART_TOKENS = 6_000_000
_LOW = np.uint64(1 << 31)
_U32, _SCALE = np.uint64(32), np.uint64(SCALE)
_SLOT = np.uint64((1 << SCALE) - 1)
_STEPS = BLOCK // LANES
_MARKS = _STEPS // CHECKPOINT


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that add up to 2**scale, in proportion to the counts and at least 1 wherever a count is."""
    counts = np.asarray(counts, dtype=np.int64)
    total, seen, room = int(counts.sum()), counts > 0, 1 << scale
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    if seen.sum() > room:
        raise ValueError("more distinct tokens than the table has room for")
    freq = np.where(seen, np.maximum(1, np.floor(counts * (room / total))), 0).astype(np.int64)
    over = int(freq.sum()) - room
    while over > 0:  # rare tokens were raised to 1: the frequent ones give way
        spare = freq - 1
        take = np.minimum(spare, np.ceil(spare * (over / max(1, int(spare.sum())))).astype(np.int64))
        short = np.cumsum(take)
        take = np.where(short <= over, take, np.maximum(0, take - (short - over)))
        freq -= np.maximum(take, 0)
        over = int(freq.sum()) - room
    freq[int(np.argmax(counts))] -= over
    return freq


class Rans:
    """Coder of tokens under one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.limit = self.freq << np.uint64(31 - SCALE + 32)

    def encode(self, chunks: list[np.ndarray]) -> list[bytes]:
        """The data of each chunk of tokens; all blocks are coded side by side."""
        sizes = [[min(BLOCK, len(c) - i) for i in range(0, len(c), BLOCK)] for c in chunks]
        flat = np.array([n for s in sizes for n in s], dtype=np.int64)
        blocks = len(flat)
        if not blocks:
            return [MAGIC + struct.pack("<II", 0, 0) for _ in chunks]
        grid = np.zeros((blocks, BLOCK), dtype=np.uint32)
        b = 0
        for c, s in zip(chunks, sizes, strict=True):
            if s:
                grid[b : b + len(s)].reshape(-1)[: len(c)] = c
                b += len(s)
        steps = np.ascontiguousarray(grid.reshape(blocks, _STEPS, LANES).transpose(1, 0, 2)).reshape(_STEPS, blocks * LANES)
        lane = np.tile(np.arange(LANES), blocks)
        room = np.repeat(flat, LANES) - lane  # the lane has a token at step t if t * LANES < room
        x = np.full(blocks * LANES, _LOW, dtype=np.uint64)
        words = np.zeros((_STEPS, blocks * LANES), dtype=np.uint32)
        given = np.zeros((_STEPS, blocks * LANES), dtype=bool)
        states = np.zeros((_MARKS, blocks * LANES), dtype=np.uint64)
        whole = int((flat.min() // LANES) if blocks else 0)
        for t in range(_STEPS - 1, -1, -1):
            s = steps[t]
            f = self.freq[s]
            out = x >= self.limit[s]
            if t >= whole:
                live = room > t * LANES
                out &= live
                f = np.where(live, f, np.uint64(1))
            words[t] = x & np.uint64(0xFFFFFFFF)
            given[t] = out
            y = np.where(out, x >> _U32, x)
            q = y // f
            y = (q << _SCALE) + (y - q * f) + self.start[s]
            x = np.where(live, y, x) if t >= whole else y
            if t % CHECKPOINT == 0:
                states[t // CHECKPOINT] = x
        per_block = given.reshape(_STEPS, blocks, LANES).transpose(1, 0, 2)
        word_rows = words.reshape(_STEPS, blocks, LANES).transpose(1, 0, 2)
        at_mark = np.concatenate([np.zeros((blocks, 1), dtype=np.int64), np.cumsum(per_block.reshape(blocks, _MARKS, CHECKPOINT * LANES).sum(axis=2), axis=1)], axis=1)
        kept = word_rows[per_block].astype("<u4")
        ends = np.cumsum(at_mark[:, -1])
        marks = states.reshape(_MARKS, blocks, LANES)
        out_data, b = [], 0
        for c, s in zip(chunks, sizes, strict=True):
            head, points, body = [MAGIC, struct.pack("<II", len(c), len(s))], [], []
            for n in s:
                n_words = int(at_mark[b, -1])
                head.append(struct.pack("<III", n, n_words, zlib.crc32(grid[b, :n].astype("<u4").tobytes())))
                for m in range(-(-n // (CHECKPOINT * LANES))):
                    points.append(marks[m, b].astype("<u8").tobytes() + struct.pack("<I", int(at_mark[b, m])))
                body.append(kept[ends[b] - n_words : ends[b]].tobytes())
                b += 1
            out_data.append(b"".join(head + points + body))
        return out_data

    def decode(self, data: list[bytes]) -> list[np.ndarray]:
        """The tokens of each chunk; every stretch between checkpoints is decoded side by side. A wrong checksum is an error."""
        stretch = CHECKPOINT * LANES
        states, places, ends, room, words, shape = [], [], [], [], [], []
        base = 0
        for d in data:
            if d[:4] != MAGIC:
                raise ValueError("not a chunk of token blocks")
            n, blocks = struct.unpack_from("<II", d, 4)
            heads = [struct.unpack_from("<III", d, 12 + 12 * k) for k in range(blocks)]
            shape.append((n, heads))
            at = 12 + 12 * blocks
            offset = base
            for size, n_words, _ in heads:
                for m in range(-(-size // stretch)):
                    states.append(np.frombuffer(d, dtype="<u8", count=LANES, offset=at))
                    (before,) = struct.unpack_from("<I", d, at + 8 * LANES)
                    places.append(offset + before)
                    ends.append(offset + n_words)
                    room.append(min(stretch, size - m * stretch))
                    at += 8 * LANES + 4
                offset += n_words
            words.append(np.frombuffer(d, dtype="<u4", offset=at))
            base = offset
        stretches = len(room)
        if not stretches:
            return [np.zeros(0, dtype=np.uint32) for _ in data]
        stream = np.concatenate([*words, np.zeros(LANES + 1, dtype="<u4")]).astype(np.uint64)
        x = np.array(states, dtype=np.uint64)
        place, size = np.array(places, dtype=np.int64), np.array(room, dtype=np.int64)
        lane = np.arange(LANES)
        left = size[:, None] - lane[None, :]
        out = np.zeros((CHECKPOINT, stretches, LANES), dtype=np.uint32)
        whole = int(size.min() // LANES)
        for t in range(-(-int(size.max()) // LANES)):
            slot = x & _SLOT
            s = self.symbol[slot]
            y = self.freq[s] * (x >> _SCALE) + slot - self.start[s]
            need = y < _LOW
            if t >= whole:
                live = left > t * LANES
                need &= live
            # lanes take their words in turn from the stretch's place on
            rank = np.cumsum(need, axis=1)
            y = np.where(need, (y << _U32) | stream[place[:, None] + rank - need], y)
            place = place + rank[:, -1]
            x = np.where(live, y, x) if t >= whole else y
            out[t] = s
        rows = np.ascontiguousarray(out.transpose(1, 0, 2)).reshape(stretches, stretch)
        result, k = [], 0
        for n, heads in shape:
            parts = []
            for size_b, _, crc in heads:
                m = -(-size_b // stretch)
                tokens = rows[k : k + m].reshape(-1)[:size_b]
                if zlib.crc32(tokens.astype("<u4").tobytes()) != crc:
                    raise ValueError("a block's checksum is wrong")
                parts.append(tokens)
                k += m
            got = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
            if len(got) != n:
                raise ValueError("a chunk's length is wrong")
            result.append(got)
        return result


def tokenise(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """``id_col`` and the text's ids with the end id, two bytes an id where the vocabulary allows it; a null text has the end id only."""
    schema = T.StructType([docs.schema[id_col], T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        kind = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], dtype=kind).tobytes()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                ids = [np.frombuffer(x, dtype="<u4").astype(kind).tobytes() + end for x in enc.encode(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], [id_col, "tokens"])

    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)


def token_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """How often each token occurs: one row a token and task, then their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            col = batch.column(0).to_pylist()
            for i in range(0, len(col), 200):
                got = np.bincount(np.frombuffer(b"".join(col[i : i + 200]), dtype=kind))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "n"])

    return tokens.select("tokens").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 1) -> str:
    """Write the ids of all texts in ascending order of ``id_col`` as token files and return their path.

    Null ids come first, rows that repeat an id follow each other in the order of their tokens, a null text counts as
    empty, other columns are left out, and an empty table gives files without blocks. Texts are encoded once; the ids are staged in
    the shared folder, counted there, range partitioned by id, and coded. Only the counts, a row for each
    entry of the vocabulary at most, reach the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))  # names of the caller can't meet ours
    id_col, text_col = "_id", "_text"
    vocabulary = vocabulary or vocabulary_path()
    path = path or new_path(spark, "token-files")
    staged, staged_path = stage(tokenise(docs, id_col, text_col, vocabulary, end_id), "tokens")
    enc_size = encoder(vocabulary).size
    kind = "<u2" if max(enc_size, end_id + 1) <= 1 << 16 else "<u4"
    counts = token_counts(staged, kind).collect()
    table = np.zeros(max(enc_size, end_id + 1), dtype=np.int64)
    for r in counts:
        table[r["token"]] = r["n"]
    freq = quantise(table)
    seen = np.flatnonzero(freq)
    spark.createDataFrame([(int(t), int(freq[t])) for t in seen], "token long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rans, part, start = Rans(freq), TaskContext.get().partitionId(), 0
        chunks: list[tuple[list, list[int], np.ndarray]] = []
        ids: list = []
        tokens: list[bytes] = []
        width, held, waiting = int(kind[-1]), 0, 0

        def close() -> None:
            nonlocal ids, tokens, held, waiting
            if tokens:
                chunks.append((ids, [len(t) // width for t in tokens], np.frombuffer(b"".join(tokens), dtype=kind)))
                waiting += held
                ids, tokens, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunks, waiting, start
            if not chunks:
                return
            data = rans.encode([c[2] for c in chunks])
            sizes = [len(c[2]) for c in chunks]
            starts = (start + np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype(np.int64)
            start += sum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(chunks), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([c[0] for c in chunks], pa.list_(id_kind)), pa.array([c[1] for c in chunks], pa.list_(pa.int32())), pa.array(data, pa.binary())], schema.fieldNames(),
            )
            chunks, waiting = [], 0

        id_kind = None
        for batch in batches:
            id_kind = batch.column(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                tokens.append(t)
                held += len(t) // width
                if held >= CHUNK_TOKENS:
                    close()
                    if waiting >= BATCH_TOKENS:
                        yield from flush()
        close()
        yield from flush()

    parts = max(1, -(-int(table.sum()) // PART_TOKENS))
    staged.repartitionByRange(parts, F.col(f"`{id_col}`")).sortWithinPartitions(F.col(f"`{id_col}`"), "tokens").mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_path(spark, staged_path)
    return path


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document of a file set: ``id_col``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers)."""
    blocks = spark.read.parquet(f"{path}/blocks")
    table = spark.read.parquet(f"{path}/table").collect()  # a row for each entry of the vocabulary at most
    freq = np.zeros(max((r["token"] for r in table), default=0) + 1, dtype=np.int64)
    for r in table:
        freq[r["token"]] = r["frequency"]
    first, firsts = 0, {}
    for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row for each file
        firsts[r["part"]] = first
        first += r["n"]
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rans = Rans(freq)
        for whole in batches:
            for i in range(0, whole.num_rows, 8):
                b = whole.slice(i, 8)
                tokens = rans.decode(b.column("data").to_pylist())
                for part, start, ids, lengths, got in zip(b.column("part").to_pylist(), b.column("part_start").to_pylist(), b.column("ids"), b.column("lengths").to_pylist(), tokens, strict=True):
                    raw, ends = got.astype("<u4").tobytes(), np.cumsum(lengths)
                    begins = ends - lengths
                    yield pa.RecordBatch.from_arrays(
                        [ids.values, pa.array(begins + firsts[part] + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array([raw[4 * x : 4 * y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())], schema.fieldNames(),
                    )

    return blocks.select("part", "part_start", "ids", "lengths", "data").mapInArrow(run, schema)
