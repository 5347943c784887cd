"""Token counts of whole texts by two tiers of lookup inside the map tasks; no pre-token is shuffled.

The first tier is a compact table of the corpus's frequent pre-tokens and how many tokens each has, broadcast to all tasks. It is found by a
pass over all texts: each task keeps a bounded summary of its most frequent pre-tokens (Misra and Gries: when it is full, what the middle entry has is
taken from all), and the summaries, a bounded row for each task, are merged in two steps. The second tier is each worker's own bounded cache, in which the library's counts of
all other pre-tokens are kept. Neither tier changes a count, only how often the library is asked.

The vocabulary has byte-level tokens and cuts texts by the pattern below; pre-tokens never span the start of a run of white space, so texts may be cut there.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import vocabulary_path

#: What the vocabularies' pattern takes for white space, and for letters and numbers below U+0250.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: A run of white space and the word after it. A carriage return holds what is around it together, since some vocabularies have pieces that end in one.
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+(?:\r[{WHITE}]*[^{WHITE}]*)*|[{WHITE}]+")
_PLAIN = re.compile("[\t-\r -~\x85\xa0-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
_PRE_TOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{WHITE}{_LETTER}{_NUMBER}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

#: Entries of the broadcast table and of a task's summary, and the longest pre-token (in bytes) that the table takes: at most 2.2 MB.
FREQUENT, LONGEST = 32_768, 64
_COUNTED = 8 * FREQUENT
_JOINED, _AT_ONCE = 1000, 50_000
MAX_CACHED, LONGEST_CACHED = 400_000, 256
_SLICE = 1 << 20
_SUMMARY = "task long, keys binary, key_bytes binary, counts binary"


def slices_of(text: str) -> Iterator[str]:
    """A long text in parts of about a megabyte that start where a run of white space does, so pre-tokens stay whole."""
    at, n = 0, len(text)
    while n - at > _SLICE:
        cut = next((m.start() for m in _STARTS.finditer(text, at + _SLICE)), n)
        yield text[at:cut]
        at = cut
    if at < n:
        yield text[at:]


_STARTS = re.compile(f"(?<=[^{WHITE}])(?!\r)[{WHITE}]")


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens. A word with letters beyond U+024F, which pattern libraries may class unlike, is one entry, for the library to cut."""
    if _PLAIN.fullmatch(text):
        return _PRE_TOKEN.findall(text)
    out: list[str] = []
    for s in SEGMENT.findall(text):
        if _PLAIN.fullmatch(s):
            out += _PRE_TOKEN.findall(s)
        else:
            out.append(s)
    return out


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library, whose special tokens stand for themselves in texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        said = json.loads(self.tok.to_str())
        cut = said["pre_tokenizer"] or {}
        plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] for t in said["added_tokens"])
        if said["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space") or not plain:
            raise ValueError(f"{path}: not a byte-level vocabulary without a normalizer")
        #: The same model for pre-tokens that are cut already.
        self.cut = Tokenizer.from_file(path)
        self.cut.no_truncation()
        self.cut.no_padding()
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\0", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def parts(self, text: str) -> tuple[list[str], int]:
        """What stands between special tokens, and how many of these there are."""
        if not self.special:
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def counts(self, keys: list[str]) -> list[int]:
        """The number of tokens of each key, a pre-token or a word for the library to cut. Pre-tokens are asked for together, with zero bytes between them."""
        out, plain = [0] * len(keys), []
        for i, k in enumerate(keys):
            if "\0" not in k and len(k) <= LONGEST and _PLAIN.fullmatch(k):
                plain.append(i)
            else:
                out[i] = len(self.tok.encode_batch_fast([k], add_special_tokens=False)[0].ids)
        for a in range(0, len(plain), _JOINED):
            some = plain[a : a + _JOINED]
            of = self.cut.encode("\0".join(keys[i] for i in some), add_special_tokens=False).word_ids
            for i, n in zip(some, np.bincount(np.array(of, dtype=np.int64), minlength=len(some)).tolist(), strict=True):
                out[i] = n
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def cut_down(counts: Counter, size: int) -> None:
    """Keep at most ``size`` entries: what the first entry beyond has is taken from all."""
    if len(counts) <= size:
        return
    values = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    less = int(-np.partition(-values, size)[size])
    left = {k: n - less for k, n in counts.items() if n > less}
    counts.clear()
    counts.update(left)


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[str]:
    for batch in batches:
        texts = batch.column(column)
        for i in range(0, len(texts), 200):
            yield from (t for t in texts.slice(i, 200).to_pylist() if t)


def _packed(task: int, counts: Counter) -> pa.RecordBatch:
    keys = [k.encode() for k in counts]
    values = (b"".join(keys), np.array([len(k) for k in keys], dtype="<u1").tobytes(), np.array(list(counts.values()), dtype="<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], ["task", "keys", "key_bytes", "counts"])


def unpacked(keys: bytes, key_bytes: bytes) -> list[str]:
    ends = np.cumsum(np.frombuffer(key_bytes, dtype="<u1")).tolist()
    return [keys[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def _summaries(texts: DataFrame, path: str, size: int) -> DataFrame:
    """A row for each task: its most frequent pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, counts = _vocabulary(path), Counter()
        for text in _texts(batches):
            for part in vocabulary.parts(text)[0]:
                for s in slices_of(part):
                    counts.update(pre_tokens(s))
                    if len(counts) > _COUNTED:
                        cut_down(counts, _COUNTED // 2)
        yield _packed(TaskContext.get().partitionId(), _short(counts, size))

    return texts.mapInArrow(run, _SUMMARY)


def _short(counts: Counter, size: int) -> Counter:
    """The most frequent of the pre-tokens that the table takes."""
    counts = Counter({k: n for k, n in counts.items() if len(k) <= LONGEST and len(k.encode()) <= LONGEST})
    cut_down(counts, size)
    return counts


def _merged(summaries: DataFrame, size: int) -> DataFrame:
    """A row for each task: the sum of the summaries that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                keys, key_bytes, values = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                counts.update(dict(zip(unpacked(keys, key_bytes), np.frombuffer(values, dtype="<i8").tolist(), strict=True)))
                cut_down(counts, 2 * size)
        cut_down(counts, size)
        if counts:
            yield _packed(TaskContext.get().partitionId(), counts)

    return summaries.mapInArrow(run, _SUMMARY)


def frequent_table(texts: DataFrame, path: str, size: int = FREQUENT) -> tuple[bytes, bytes, bytes]:
    """At most ``size`` frequent pre-tokens of the column ``text``: their bytes joined, their lengths in bytes, and their numbers of tokens.

    One row of at most 72 bytes an entry reaches the driver.
    """
    partly = _merged(_summaries(texts, path, size).repartition(64, "task"), size)
    found = _merged(partly.repartition(1), size).first()
    if found is None:
        return b"", b"", b""
    keys = unpacked(bytes(found["keys"]), bytes(found["key_bytes"]))
    return bytes(found["keys"]), bytes(found["key_bytes"]), np.array(_vocabulary(path).counts(keys), dtype="<u1").tobytes()


class Counting:
    """A worker's two tiers: the table, and a cache that is emptied when full."""

    def __init__(self, path: str, table: tuple[bytes, bytes, bytes], max_cached: int = MAX_CACHED):
        self.vocabulary, self.max_cached = _vocabulary(path), max_cached
        self.table = dict(zip(unpacked(table[0], table[1]), table[2], strict=True))
        self.cache: dict[str, int] = {}

    def _missed(self, keys: list[str]) -> list[int]:
        """The tokens of pre-tokens that the table lacks."""
        found = list(map(self.cache.get, keys))
        if None in found:
            new = list({k for k, n in zip(keys, found, strict=True) if n is None})
            learned = dict(zip(new, self.vocabulary.counts(new), strict=True))
            keep = {k: n for k, n in learned.items() if len(k) <= LONGEST_CACHED}
            if len(self.cache) + len(keep) > self.max_cached:
                self.cache = {}
            self.cache.update(keep)
            found = [learned[k] if n is None else n for k, n in zip(keys, found, strict=True)]
        return found

    def count(self, texts: list[str | None]) -> list[int]:
        out, missed, of = [0] * len(texts), [], []

        def settle() -> None:
            for i, n in zip(of, self._missed(missed), strict=True):
                out[i] += n
            missed.clear()
            of.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            parts, out[i] = self.vocabulary.parts(text)
            for part in parts:
                for s in slices_of(part):
                    keys = pre_tokens(s)
                    known = list(map(self.table.get, keys))
                    if None in known:
                        some = [k for k, n in zip(keys, known, strict=True) if n is None]
                        missed += some
                        of += [i] * len(some)
                        known = [n for n in known if n is not None]
                    out[i] += sum(known)
                    if len(missed) > _AT_ONCE:
                        settle()
        settle()
        return out


_COUNTING: dict[str, Counting] = {}


def _counting(name: str, path: str, table: Broadcast) -> Counting:
    """This worker's tiers for a broadcast table of that name; those of an earlier one are dropped."""
    if name not in _COUNTING:
        _COUNTING.clear()
        _COUNTING[name] = Counting(path, table.value)
    return _COUNTING[name]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, vocabulary: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: its id, ``n_bytes`` of its UTF-8 text, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Special tokens inside texts count as one token each, as the library counts them by default; none are added. A null or empty text has no
    bytes and no tokens. Repeated rows are counted each, null ids stay null, an empty table gives no rows. Other columns are not read; an ``id_col`` named like an
    added column raises.
    """
    if id_col in (added := ("n_bytes", "n_tokens", "over_limit")):
        raise ValueError(f"columns would clash: {id_col} is one of {added}")
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(rows.select("text").where("text IS NOT NULL"), path, frequent))
    name = uuid.uuid4().hex
    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _counting(name, path, table)
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                n = counting.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(n, pa.int64())], schema.fieldNames())

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return rows.select("id", "text", n_bytes.alias("n_bytes")).mapInArrow(run, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
