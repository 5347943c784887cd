"""Alignment of two tokenizers' tokens over whole texts, and how often ids are linked over the corpus.

A text with a space before it is cut by a byte-level BPE vocabulary (A) and by a sentencepiece model (B). Tokens whose byte ranges overlap are edges of a bipartite
graph. Union-find joins them; as both sides cover the same bytes in order, its components are the minimal groups: both sides
end where a component ends, and nowhere inside one. Each component's members are expanded into the links asked for: pairs that end together, or all that overlap.

Neither side joins bytes over the start of a run of white space, so every distinct word of a batch is cut and aligned once. A batch of about BATCH_BYTES of text is staged as its
words and their places. Link counts: each batch gives its distinct id pairs with their counts, a grouping adds them up, and each batch gets back the sums of the pairs that it has. So a pair that is
everywhere costs a batch one row, no document's links are shuffled, and nothing reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, small_side, stage
from .token_counts import SEGMENT, WHITE, Vocabulary
from .tokens import vocabulary_path

BATCH_BYTES = 8 << 20
_ADDED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
_SHIFT = 32


def byte_level() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable Latin-1 for itself, all others from U+0100 up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of tokens whose byte ranges overlap, in order: no byte lies in more than one token of a side, so each stretch between neighbouring ends gives one pair."""
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its connected component, by hooking roots onto smaller roots of their neighbours and halving paths, for all edges at once."""
    up = np.arange(n)
    while True:
        x, y = up[u], up[v]
        apart = x != y
        if not apart.any():
            return up
        np.minimum.at(up, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while not np.array_equal(up, up[up]):
            up = up[up]


def components(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group of each token of A and of B, numbered in order, and the overlapping pairs. Both sides cover the bytes from 0 to the same end."""
    i, j = overlaps(a_ends, b_ends)
    root = union_find(len(a_ends) + len(b_ends), i, len(a_ends) + j)
    first = np.flatnonzero(root[: len(a_ends)] == np.arange(len(a_ends)))  # a group's smallest node is its first token of A
    return np.searchsorted(first, root[: len(a_ends)]), np.searchsorted(first, root[len(a_ends) :]), i, j


class Places(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Aligned(NamedTuple):
    """The alignment of many words, one after the other."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    links: np.ndarray
    n_links: np.ndarray


class Aligner:
    """Cuts and aligns words under both vocabularies, many in one call of each library: a control character that no token joins to others stands between words."""

    def __init__(self, a_path: str, b_path: str, links: str):
        import sentencepiece
        from tokenizers import pre_tokenizers

        self.a = Vocabulary(a_path)
        self.a.tok.encode_special_tokens = True
        chars = byte_level()
        names = {i: t for t, i in self.a.tok.get_vocab().items()}
        self.a_size = np.array([len(names[i]) if i in names and all(c in chars for c in names[i]) else len(names.get(i, "").encode()) for i in range(max(names) + 1)])
        self.a.cut.encode_special_tokens = True
        self.a.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(_BETWEEN, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(m.group() != "\r" for p in pieces for m in re.finditer(f"(?<=[^{WHITE}▁])[{WHITE}▁]|(?<=▁)[{WHITE}]", p)) or any(_BETWEEN in p and p != _BETWEEN for p in pieces):
            raise ValueError(f"{b_path}: pieces run over the start of white space, or hold a space and other white space")
        self.b_bytes = np.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], dtype=object)
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.space, self.between = self.b.piece_to_id("▁"), self.b.encode("a" + _BETWEEN)[-1]
        self.all_links = links == "overlap"
        self.numbers = np.array([str(i) for i in range(max(len(self.a_size), len(pieces)))], dtype=object)

    def _a_ids(self, words: list[str]) -> np.ndarray:
        """All words' tokens of A; a word with the control character is asked for alone."""
        if any(_BETWEEN in w for w in words):
            return np.array([i for w in words for i in self.a.tok.encode_batch_fast([w], add_special_tokens=False)[0].ids], dtype=np.int64)
        return np.array(self.a.cut.encode_batch_fast([_BETWEEN.join(words)], add_special_tokens=False)[0].ids, dtype=np.int64)

    def _b_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' tokens of B and how many each word has. The library puts a space before what it is given, which is left out again."""
        if any(_BETWEEN in w for w in words):
            each = [self.b.encode(_BETWEEN + w, num_threads=1)[2:] for w in words]
            return np.array([i for e in each for i in e], dtype=np.int64), np.array([len(e) for e in each])
        ids = np.array(self.b.encode(_BETWEEN + _BETWEEN.join(words), num_threads=1)[1:], dtype=np.int64)
        at = np.flatnonzero(ids == self.between)
        return np.delete(ids, at), np.diff(np.append(at, len(ids))) - 1

    def align(self, words: list[str]) -> Aligned:
        """The alignment of each word; one whose tokens don't give its bytes is not good and has no tokens, groups and links."""
        parts = [self._align(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)]
        joined = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in (0, 1, 2, 3, 5, 6)]
        return Aligned(*joined[:4], [g for p in parts for g in p.groups], *joined[4:])

    def _align(self, words: list[str]) -> Aligned:
        raws = [w.encode() for w in words]
        size = np.array([len(r) for r in raws])
        a, (b, n_b) = self._a_ids(words), self._b_ids(words)
        b_of = np.repeat(np.arange(len(words)), n_b)
        good = np.bincount(b_of, weights=self.b_size[b], minlength=len(words)).astype(np.int64) == size
        if not good.all() or b"".join(self.b_bytes[b].tolist()) != b"".join(raws):
            at = np.append(0, np.cumsum(n_b))
            good = np.array([b"".join(self.b_bytes[b[at[i] : at[i + 1]]].tolist()) == r for i, r in enumerate(raws)], dtype=bool)
        a_of = np.searchsorted(np.cumsum(size), np.cumsum(self.a_size[a]))  # A gives back all bytes
        a, a_of, b, b_of = a[good[a_of]], a_of[good[a_of]], b[good[b_of]], b_of[good[b_of]]
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_group, b_group, i, j = components(a_ends, b_ends)
        if not self.all_links:
            together = a_ends[i] == b_ends[j]
            i, j = i[together], j[together]
        count = lambda of: np.bincount(of, minlength=len(words))
        last = np.append(a_group[1:] != a_group[:-1], True) if len(a) else np.zeros(0, dtype=bool)
        return Aligned(good, count(a_of), count(b_of), count(a_of[last]), self._said(a, a_group, b, b_group, a_of, good), a[i] << _SHIFT | b[j], count(a_of[i]))

    def _said(self, a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, a_of: np.ndarray, good: np.ndarray) -> list[str]:
        """The groups of each word as text: every token's number and the sign after it, joined once for all words."""
        ids, group = np.concatenate([a, b]), np.concatenate([a_group, b_group])
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((np.arange(len(ids)), side, group))
        group, side = group[order], side[order]
        word = np.zeros(int(a_group[-1]) + 1 if len(a) else 0, dtype=np.int64)
        word[a_group] = a_of
        word = word[group]
        same = lambda x: np.append(x[1:] == x[:-1], False) if len(x) else np.zeros(0, dtype=bool)
        sign = np.where(same(word), np.where(same(group), np.where(same(side), 0, 1), 2), 3)
        text = np.empty(2 * len(ids), dtype=object)
        text[0::2] = self.numbers[ids[order]]
        text[1::2] = _SIGNS[sign]
        said = iter("".join(text.tolist()).split("\n"))
        return [next(said) if g else "" for g in good]


_BETWEEN, _JOINED = "\x01", 2000
_SIGNS = np.array([",", "|", ";", "\n"], dtype=object)
_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(*key: str) -> Aligner:
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up in as few bytes each as hold the largest, byte by byte and compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw[1:]), dtype=np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel().astype(np.int64)


_PACKED = ["words", "n_a", "n_b", "n_groups", "n_links", "links", "pairs"]
_BATCH = "batch long, n_words array<int>, groups binary, " + ", ".join(f"{c} binary" for c in _PACKED)


def _batches(rows: DataFrame, key: tuple[str, str, str], batch_bytes: int) -> DataFrame:
    """A row for each batch: its documents' ids and words, and each distinct word's alignment and how often it is there.

    ``n_words`` is a document's number of words, none if it has no tokens; ``links`` are places among the batch's distinct ``pairs``.
    """
    schema = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), *T.StructType.fromDDL(_BATCH).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, made = _aligner(*key), TaskContext.get().partitionId() << 32
        place = Places()
        ids, docs, held = [], [], 0

        def close() -> pa.RecordBatch:
            found = aligner.align(list(place))
            n = [len(d) if d is not None and found.good[d].all() else 0 for d in docs]
            words = np.concatenate([np.zeros(0, dtype="<u4"), *(d for d, k in zip(docs, n, strict=True) if k)])
            pairs, links = np.unique(found.links, return_inverse=True)
            packed = (words, found.n_a, found.n_b, found.n_groups, found.n_links, links, pairs)
            columns = [pa.array([ids], pa.list_(id_type)), pa.array([made], pa.int64()), pa.array([n], pa.list_(pa.int32()))]
            columns += [pa.array([x], pa.binary()) for x in (zlib.compress("\n".join(found.groups).encode(), 1), *map(pack, packed))]
            return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i in range(0, batch.num_rows, 200):
                for key_of, text in zip(*(batch.column(c).slice(i, 200).to_pylist() for c in ("id", "text")), strict=True):
                    size = len(text or "") * 2
                    if ids and held + size > batch_bytes:
                        yield close()
                        made += 1
                        ids, docs, held = [], [], 0
                        place.clear()
                    ids.append(key_of)
                    held += size + 16
                    docs.append(np.array([*map(place.__getitem__, SEGMENT.findall(" " + text))], dtype="<u4") if text else None)
        if ids:
            yield close()

    return rows.mapInArrow(run, schema)


def _asked(batches: DataFrame) -> DataFrame:
    """Each batch's distinct id pairs and how many links hold them there."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for several in rows:
            for i in range(several.num_rows):
                batch, (links, n_links, pairs, words) = several.column(0)[i].as_py(), (unpack(several.column(c)[i].as_py()) for c in range(1, 5))
                times = np.bincount(words, minlength=len(n_links))
                n = np.bincount(links, weights=np.repeat(times, n_links), minlength=len(pairs)).astype(np.int64)
                some = np.flatnonzero(n)  # words of documents without tokens count for nothing
                for k in range(0, len(some), 100_000):
                    part = some[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch)), pa.array(pairs[part]), pa.array(n[part])], ["batch", "pair", "n"])

    return batches.select("batch", "links", "n_links", "pairs", "words").mapInArrow(run, "batch long, pair long, n long")


def _finish(names: list[str]):
    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        row = {c: held.column(c)[0] for c in held.column_names}
        x = {c: unpack(row[c].as_py()) for c in _PACKED}
        of = np.repeat(np.arange(len(x["n_links"])), x["n_links"])
        place = np.searchsorted(x["pairs"], np.array(answers.column("pair")))
        for name, column in (("n_best", "best"), ("count_sum", "count")):
            value = np.zeros(len(x["pairs"]), dtype=np.int64)
            value[place] = np.array(answers.column(column))
            x[name] = np.zeros(len(x["n_links"]), dtype=np.int64)
            np.add.at(x[name], of, value[x["links"]])
        sizes = np.array(row["n_words"].as_py(), dtype=np.int64)
        ends = np.cumsum(sizes)
        columns = [row["ids"].values]
        for name in names[1:-1]:
            sums = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(x[name][x["words"]])])
            columns.append(pa.array(sums[ends] - sums[ends - sizes]))
        groups = np.array(zlib.decompress(row["groups"].as_py()).decode().split("\n"), dtype=object)
        columns.append(pa.array([";".join(groups[x["words"][e - n : e]].tolist()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.string()))
        return pa.Table.from_arrays(columns, names)

    return run


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_vocabulary: str | None = None, b_model: str | None = None, links: str = "end", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per document: its id, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups``.

    ``groups`` has the minimal groups in order, 'a1,a2|b1;a3|b2,b3' with ids of A and B. ``links`` says which pairs of token occurrences of a group
    are linked: those that end together ('end') or all that overlap ('overlap'). A pair of ids counts the links of the whole corpus that hold it; ``count_sum`` sums the counts of a document's
    links, ``n_best`` counts those whose count is the highest that their id of B has, ties included.

    Texts that are null or empty, or that a side's tokens do not give back byte by byte, have zeros and ''. Strings of special tokens are plain text. Repeated rows and
    null ids are documents like others; an empty table gives no rows. Other columns are not read; an ``id_col`` named like an added column raises.
    """
    if id_col in _ADDED:
        raise ValueError(f"columns would clash: {id_col} is one of {_ADDED}")
    if links not in ("end", "overlap"):
        raise ValueError(f"links: {links!r} is neither 'end' nor 'overlap'")
    spark = docs.sparkSession
    key = (a_vocabulary or vocabulary_path("byte_bpe_50k.json"), b_model or vocabulary_path("piece_bpe_32k.model"), links)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    batches, _ = stage(_batches(rows, key, batch_bytes), "aligned")
    asked, _ = stage(_asked(batches), "pairs")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    counts, counts_path = stage(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))), "counts")
    most, most_path = stage(counts.groupBy("b").agg(F.max("count").alias("most")), "most")
    sums = counts.join(small_side(most, 24), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    sums, _ = stage(sums, "sums")
    answers = asked.select("batch", "pair").join(small_side(sums, 24), "pair")
    schema = T.StructType().add("id", docs.schema[id_col].dataType)
    for c in _ADDED[:-1]:
        schema = schema.add(c, "long")
    finish = _finish(schema.fieldNames() + ["groups"])
    out = batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, schema.add("groups", "string"))
    for p in (counts_path, most_path):
        drop_path(spark, p)
    return out.select(F.col("id").alias(id_col), *_ADDED)
