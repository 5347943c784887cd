"""BPE encoding by a prefix-sharing trie, and decoding.

The last token of a prefix's BPE encoding fixes the rest: it is the one vocabulary entry that ends the prefix and that
stays apart from the last token of what lies before it. So a word needs one state a symbol, the last token,
and words with a common prefix share those states. The distinct words of a batch are put in a trie (sorted, each hangs
on the path it shares with its predecessor) and walked depth first; a state is computed once for all words below it.
The word's own last symbol carries the end mark, so that only the leaf is its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import _AT_ONCE, MAX_CACHED, vocabulary_path, words_of

_END = "</w>"
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class TrieBpe:
    """Encoder and decoder for a byte-level BPE vocabulary whose words end in ``</w>``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.added = added
        n = max([*self.vocab.values(), *added.values()]) + 1
        self.text = [""] * n
        for t, i in [*self.vocab.items(), *added.items()]:
            self.text[i] = t
        self.raw = [t.encode() for t in self.text]
        #: rank of each merge by its two sides, and the sides of each merged token
        self.rank: dict[int, int] = {}
        self.sides: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(model["model"]["merges"]):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab.get(a + b)
            self.rank[x << 20 | y] = r
            if z is not None and z not in self.sides:
                self.sides[z] = (r, x, y)
        plain = {t: i for t, i in self.vocab.items() if not t.endswith(_END)}
        self.inner = plain
        self.final = {t[: -len(_END)]: i for t, i in self.vocab.items() if t.endswith(_END) and t != _END}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.symbols = byte_symbols()
        self.table = {i: c for i, c in enumerate(self.symbols)}
        self.apart: dict[int, bool] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.words: dict[str, bytes] = {}
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def _spine(self, t: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of t as its merges grow it: (token, rank of the merge that takes it up)."""
        out, until = [], _NEVER
        while True:
            out.append((t, until))
            if t not in self.sides:
                return out[::-1]
            until, t = self.sides[t][0], self.sides[t][side]

    def _apart(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay two tokens: no merge joins them before each is whole, nor after."""
        key = a << 20 | b
        got = self.apart.get(key)
        if got is None:
            ra = self.right.get(a) or self.right.setdefault(a, self._spine(a, 2))
            lb = self.left.get(b) or self.left.setdefault(b, self._spine(b, 1))
            i = j = 0
            rank = self.rank.get
            while True:
                (x, next_a), (y, next_b) = ra[i], lb[j]
                r = rank(x << 20 | y, _NEVER)
                # of equal merges the leftmost goes first: those inside a before, those inside b after
                if r < next_a and r <= next_b and r < _NEVER:
                    got = False
                    break
                if next_a == _NEVER and next_b == _NEVER:
                    got = True
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
            if len(self.apart) >= 2_000_000:
                self.apart = {}
            self.apart[key] = got
        return got

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words in byte symbols, without end mark: one depth-first walk over their trie."""
        inner, final, longest, apart = self.inner, self.final, self.longest, self._apart
        out: dict[str, bytes] = {}
        path: list[int] = [-1]  # the last token of each prefix of the current word; -1 at the root
        before = ""
        for w in sorted(words):
            m = len(w)
            # keep the states of the prefix shared with the word before
            k, most = 0, min(m - 1, len(path) - 1)
            while k < most and w[k] == before[k]:
                k += 1
            del path[k + 1 :]
            for i in range(k + 1, m + 1):
                table = final if i == m else inner
                last = -1
                for j in range(max(0, i - longest), i):
                    t = table.get(w[j:i])
                    if t is not None and (j == 0 or apart(path[j], t)) and self._whole(t):
                        last = t
                        break
                if last < 0:
                    raise ValueError(f"no token ends {w[:i]!r}")
                if i < m:
                    path.append(last)
                else:
                    end = last
            ids, t, i = [], end, m
            while True:
                ids.append(t)
                i -= len(self.text[t]) - (len(_END) if i == m else 0)
                if i == 0:
                    break
                t = path[i]
            out[w] = b"".join(t.to_bytes(4, "little") for t in reversed(ids))
            before = w
        return out

    def _whole(self, t: int) -> bool:
        """Whether a token's own text encodes to itself: its sides are whole and stay apart until its merge joins them."""
        side = self.sides.get(t)
        if side is None:
            return True
        key = -1 - t
        got = self.apart.get(key)
        if got is None:
            r, a, b = side
            got = self._whole(a) and self._whole(b) and self._joined_at(a, b, r)
            self.apart[key] = got
        return got

    def _joined_at(self, a: int, b: int, r: int) -> bool:
        ra, lb, i, j = self._spine(a, 2), self._spine(b, 1), 0, 0
        while (i, j) != (len(ra) - 1, len(lb) - 1):
            (x, next_a), (y, next_b) = ra[i], lb[j]
            q = self.rank.get(x << 20 | y, _NEVER)
            if q < next_a and q <= next_b and q < _NEVER:
                return False
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        return True

    def _learn(self, new: list[str]) -> None:
        mapped: dict[str, str] = {}
        odd: list[str] = []
        for w in new:
            if w[0] == " ":
                odd.append(w)
            else:
                mapped[w] = w.encode().decode("latin-1").translate(self.table)
        parts: dict[str, list] = {}
        for w in odd:
            parts[w] = self._cut(w[1:])
        distinct = set(mapped.values())
        for p in parts.values():
            distinct.update(x for x in p if isinstance(x, str))
        got = self.encode_words(list(distinct))
        for w, s in mapped.items():
            self.words[w] = got[s]
        for w, p in parts.items():
            self.words[w] = b"".join(got[x] if isinstance(x, str) else x.to_bytes(4, "little") for x in p)

    def _cut(self, piece: str) -> list[str | int]:
        """Pre-tokens of a piece under the vocabulary's own normaliser and pattern; ids of added tokens as they stand in it."""
        out: list[str | int] = []
        while piece:
            at, t = min(((i, t) for t in self.added if (i := piece.find(t)) >= 0), default=(len(piece), ""))
            if at:
                text = self.library.normalizer.normalize_str(piece[:at])
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text) if w]
            if t:
                out.append(self.added[t])
            piece = piece[at + len(t) :]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        split = words_of(text)
        if len(split) > _AT_ONCE:
            return b"".join(b"".join(self._ids(split[i : i + _AT_ONCE])) for i in range(0, len(split), _AT_ONCE))
        return b"".join(self._ids(split))

    def _ids(self, split: list[str]) -> list[bytes]:
        ids = list(map(self.words.get, split))
        if None in ids:
            gaps = [i for i, x in enumerate(ids) if x is None]
            self.learn({split[i] for i in gaps})
            for i in gaps:
                ids[i] = self.words[split[i]]
        return ids

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > MAX_CACHED:
            self.words, new = {}, list(words)
        if new:
            self._learn(new)

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Encode texts in groups, so that the new words of a group share one trie."""
        group: list[list[str]] = []
        held = 0

        def flush() -> Iterator[bytes]:
            flat = [w for s in group for w in s]
            ids, at = self._ids(flat), 0
            for s in group:
                yield b"".join(ids[at : at + len(s)])
                at += len(s)

        for t in texts:
            split = words_of(t)
            if held + len(split) > 4 * _AT_ONCE:
                yield from flush()
                group, held = [], 0
            if len(split) > 4 * _AT_ONCE:
                yield b"".join(b"".join(self._ids(split[i : i + _AT_ONCE])) for i in range(0, len(split), _AT_ONCE))
                continue
            group.append(split)
            held += len(split)
        yield from flush()

    def decode(self, ids: bytes) -> bytes:
        """The library's decode(ids, skip_special_tokens=False) in UTF-8: this vocabulary names no decoder, so tokens are joined by spaces."""
        return b" ".join(map(self.raw.__getitem__, memoryview(ids).cast("I")))


_CODECS: dict[str, TrieBpe] = {}


def codec(path: str) -> TrieBpe:
    """This worker's encoder of the vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = TrieBpe(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, digest_only: bool = False) -> DataFrame:
    """Each row with the ids of its whole text and their decoded text, in place of the text.

    Adds ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``; with ``digest_only`` the hex SHA-256 of
    both (``ids_sha256``, ``decoded_sha256``) instead. A null text counts as empty, an empty text has no ids, repeated rows
    each give a row, and an empty table gives none. Columns of these names in ``docs`` are an error.
    Rows are not shuffled.
    """
    path = vocabulary or vocabulary_path()
    added = [("n_tokens", "long"), *([("ids_sha256", "string"), ("decoded_sha256", "string")] if digest_only else [("ids", "binary"), ("decoded", "string")])]
    keep = [f for f in docs.schema.fields if f.name != text_col]
    if clash := {f.name for f in keep} & {n for n, _ in added}:
        raise ValueError(f"columns would clash: {sorted(clash)}")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in keep])
    for name, kind in added:
        schema = schema.add(name, kind)
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                n, a, b = [], [], []
                for ids in bpe.encode_all(batch.column(text_col).to_pylist()):
                    decoded = bpe.decode(ids)
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest() if digest_only else ids)
                    b.append(hashlib.sha256(decoded).hexdigest() if digest_only else decoded.decode())
                new = [pa.array(n, pa.int64()), pa.array(a, pa.string() if digest_only else pa.binary()), pa.array(b, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + new, names + [x for x, _ in added])

    return docs.select(*[f"`{n}`" for n in names], f"`{text_col}`").mapInArrow(run, schema)
