"""Whole texts to token ids with a public word BPE tokenizer, one library call for each new word.

The vocabulary ``word_bpe_49k`` drops white space, and no pre-token spans it, so the ids of a text
are those of its pieces between ASCII white space, one after the other. Pieces repeat, so each worker keeps
the ids of those it has met and asks the ``tokenizers`` library only about new ones. The memory is bounded:
a cache that is full is emptied and fills again.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Texts and pieces of these characters only have the same words under our pattern and under the vocabulary's own.
_PLAIN_TEXT = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_WORDS = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-zß-öø-ÿ0-9\s]+")
MAX_CACHED = 600_000
_JOINED = 400
_AT_ONCE = 60_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary lies; callers may pass any other path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: str | None) -> list[str]:
    """The text's pre-tokens in lower case. A piece that only the library can cut is given whole, behind a space."""
    if not text:
        return []
    if "<|" not in text and _PLAIN_TEXT.fullmatch(text):
        return _WORDS.findall(text.lower())
    out: list[str] = []
    for piece in text.encode().split():
        p = piece.decode()
        if "<|" in p or not _PLAIN.fullmatch(p):
            out.append(" " + p)
        else:
            out += _WORDS.findall(p.lower())
    return out


class WordEncoder:
    """Encodes texts as the tokenizers library does with add_special_tokens=False."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        #: The same model for words that are cut and lower-cased already.
        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tok.get_vocab()
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ask the library for the ids of new words, many in one text: every word ends in a token that ends words."""
        plain = [w for w in new if w[0] != " "]
        for i in range(0, len(plain), _JOINED):
            some = plain[i : i + _JOINED]
            ids = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                raw, at = ids.tobytes(), 0
                for w, end in zip(some, (cuts * 4).tolist(), strict=True):
                    self.words[w] = raw[at:end]
                    at = end
            else:
                self.words.update(zip(some, self._library(some), strict=True))
        odd = [w for w in new if w[0] == " "]
        for i in range(0, len(odd), _JOINED):
            some = odd[i : i + _JOINED]
            self.words.update(zip(some, self._library([w[1:] for w in some]), strict=True))

    def _ids(self, split: list[str]) -> list[bytes]:
        """The ids of each word; at most _AT_ONCE words a call."""
        ids = list(map(self.words.get, split))
        if None in ids:
            gaps = [i for i, x in enumerate(ids) if x is None]
            new = list({split[i] for i in gaps})
            if len(self.words) + len(new) > MAX_CACHED:
                self.words = {}
            self._learn(new)
            for i in gaps:
                ids[i] = self.words[split[i]]
        return ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order, as little-endian unsigned 32-bit integers; a null text has none."""
        some: list[str] = []
        ends: list[int] = []
        for t in texts:
            split = words_of(t)
            if len(some) + len(split) > _AT_ONCE:
                yield from self._cut(some, ends)
                some, ends = [], []
            if len(split) > _AT_ONCE:
                yield b"".join(b"".join(self._ids(split[i : i + _AT_ONCE])) for i in range(0, len(split), _AT_ONCE))
                continue
            some += split
            ends.append(len(some))
        yield from self._cut(some, ends)

    def _cut(self, some: list[str], ends: list[int]) -> Iterator[bytes]:
        ids, at = self._ids(some), 0
        for end in ends:
            yield b"".join(ids[at:end])
            at = end


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of the vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
