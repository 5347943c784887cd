"""Quality rules on whole texts: plain counts and tokeniser fertility.

Fertility says how well public vocabularies fit a text: characters per token under two of them, the share of byte-fallback tokens, and
the entropy of the text's tokens. Each measure has a band per language or script; a text outside any band is rejected. The bands are a table that is shipped, so a text's verdict
rests on the text alone, whatever lies beside it.
Words are runs of characters other than ASCII white space and are encoded one by one, so a worker keeps
the tokens of words it has met (a bounded cache) and asks the vocabularies only about new ones.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import vocabulary_path

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
MAX_CACHED = 400_000
#: How many quartile ranges below its language's median a text may lie, and the least such range as a share of the median.
SPREAD, LEAST_RANGE = 4, 0.02
_AT_ONCE = 50_000


@dataclass(frozen=True)
class Band:
    """What a text may measure: characters per token under the two vocabularies from low and low_other to high, byte-fallback share and relative entropy.

    Relative entropy is bits per token over the most that so many tokens (4096 at most) could have.
    """

    low: float
    low_other: float
    high: float
    max_byte_share: float
    min_entropy: float


#: Rejection bands by language, then by script. The low ends of the four languages were fitted once by :func:`fitted_lows` on the 9,066 texts of the synthetic table of
#: 10,000 documents that pass the plain counts; natural prose in them has 2.5 characters per token and more. All other values are wide on purpose: they are to find text that the vocabularies
#: can't be meant for, such as noise or one word over and over, not rare prose.
BANDS: dict[str, Band] = {
    "en": Band(2.02, 2.12, 12.0, 0.10, 0.42),
    "de": Band(2.03, 1.96, 12.0, 0.10, 0.42),
    "fr": Band(1.78, 1.79, 12.0, 0.10, 0.42),
    "es": Band(1.74, 1.78, 12.0, 0.10, 0.42),
    "latin": Band(1.2, 1.0, 12.0, 0.15, 0.42),
    "cyrillic": Band(1.0, 0.4, 9.0, 0.20, 0.42),
    "cjk": Band(0.3, 0.25, 3.0, 0.80, 0.35),
    "other": Band(0.25, 0.15, 9.0, 0.95, 0.30),
}
_NAMED = {
    "latin": "A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u1d00-\u1d25\u1e00-\u1eff\u2c60-\u2c7f\ua722-\ua787\ufb00-\ufb06\uff21-\uff3a\uff41-\uff5a",
    "cyrillic": "\u0400-\u052f\u1c80-\u1c8f\ua640-\ua69f",
    "cjk": "\u1100-\u11ff\u3005-\u3007\u3040-\u312f\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\uff66-\uffdc\U00020000-\U000323af",
}
_LETTERS = {name: re.compile(f"[{chars}]+") for name, chars in _NAMED.items()}
_ANY_NAMED = re.compile(f"[{''.join(_NAMED.values())}]+")


def script_of(text: str) -> str:
    """The script of most letters, where all letters of no named script count as "other"; Latin where all is ASCII, "other" without a letter.

    At a tie a named script goes before "other".
    """
    if text.isascii():
        return "latin"
    found = [(sum(map(len, p.findall(text))), name) for name, p in _LETTERS.items()]
    found.append((sum(map(str.isalpha, _ANY_NAMED.sub("", text))), "other"))
    n, name = max(found, key=lambda x: x[0])
    return name if n else "other"


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that the text holds twice or more, the first time included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            x = hashes[k : k + n] * np.uint64(2 * k + 1) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h += x ^ (x >> np.uint64(32))
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    ends = np.zeros(len(hashes) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + window, -1)
    return int((np.cumsum(ends)[:-1] > 0).sum())


#: A character that stands between words where many are encoded at once, and the pattern of the second vocabulary with it as a piece of its own.
_BETWEEN, _JOINED = "\x01", 2000
_PATTERN = r"\x01|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+(?![^\s\x01])|\s+"


class Fertility:
    """Token ids of words under a sentencepiece vocabulary with byte fallback, and numbers of tokens under a byte-level one, given as ranks."""

    def __init__(self, path: str, other: str):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        with open(other, "rb") as f:
            ranks = {base64.b64decode(k): int(n) for k, n in map(bytes.split, f)}
        self.other = tiktoken.Encoding("second", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        own = _PATTERN.removeprefix(r"\x01|").replace(r"(?![^\s\x01])", r"(?!\S)").replace(r"\x01", "")
        self.alone = tiktoken.Encoding("own", pat_str=own, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        if any(_BETWEEN in p and p != _BETWEEN for p in pieces) or any(b"\x01" in k and k != b"\x01" for k in ranks):
            raise ValueError("a vocabulary joins the control character between words to others")
        self.between, self.other_between = self.sp.encode("a" + _BETWEEN)[-1], ranks[b"\x01"]
        self.lengths: dict[bytes, int] = {}
        self.is_byte = np.array([self.sp.IsByte(i) for i in range(self.sp.vocab_size())])
        self.kind = "<u2" if len(self.is_byte) <= 1 << 16 else "<u4"
        self.words: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> None:
        """Ask both libraries for words, many in one text; a word with the control character is asked for alone."""
        plain = [w.decode() for w in new]
        odd = [i for i, w in enumerate(plain) if _BETWEEN in w]
        for i in odd:
            self.words[new[i]] = np.array(self.sp.encode(plain[i], num_threads=1), dtype=self.kind).tobytes()
            self.lengths[new[i]] = len(self.alone.encode_ordinary(plain[i]))
        left = [i for i in range(len(new)) if _BETWEEN not in plain[i]] if odd else range(len(new))
        for a in range(0, len(left), _JOINED):
            some = left[a : a + _JOINED]
            sign = _BETWEEN + " "
            ids = np.array(self.sp.encode(sign + sign.join(plain[i] for i in some), num_threads=1)[1:], dtype=self.kind)
            at = np.flatnonzero(ids == self.between)
            ends = np.append(at[1:], len(ids)) * ids.itemsize
            own = np.array(self.other.encode_ordinary(_BETWEEN + _BETWEEN.join(plain[i] for i in some)))
            counts = np.diff(np.append(np.flatnonzero(own == self.other_between), len(own))) - 1
            raw = ids.tobytes()
            for i, start, end, n in zip(some, ((at + 1) * ids.itemsize).tolist(), ends.tolist(), counts.tolist(), strict=True):
                self.words[new[i]] = raw[start:end]
                self.lengths[new[i]] = n

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(words) > _AT_ONCE:
            return np.concatenate([self.ids(words[i : i + _AT_ONCE]) for i in range(0, len(words), _AT_ONCE)])
        got = list(map(self.words.get, words))
        if None in got:
            gaps = [i for i, x in enumerate(got) if x is None]
            new = list({words[i] for i in gaps})
            if self.words and len(self.words) + len(new) > MAX_CACHED:
                self.words, self.lengths = {}, {}
                return self.ids(words)  # those found before are gone too
            self._learn(new)
            got = [self.words.get(w) if x is None else x for w, x in zip(words, got, strict=True)]
        self.n_other += sum(map(self.lengths.__getitem__, words))
        return np.frombuffer(b"".join(got), dtype=self.kind)

    def measure(self, words: list[bytes], chars: int) -> tuple[float, float, float, float, int]:
        """Characters per token under both vocabularies, byte-fallback share, relative token entropy, number of tokens; a text without words has none."""
        self.n_other = 0
        ids = self.ids(words)
        n = len(ids)
        if not n:
            return 0.0, 0.0, 0.0, 0.0, 0
        counts = np.bincount(ids)
        counts = counts[counts > 0]
        p = counts / n
        bits = float(-(p * np.log2(p)).sum())
        return chars / n, chars / max(1, self.n_other), float(self.is_byte[ids].sum() / n), bits / np.log2(min(n, 4096)) if n > 1 else 0.0, n


_FERTILITY: dict[tuple[str, str], Fertility] = {}

RULE_FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("n_pieces", "long"), ("chars_per_token", "double"), ("chars_per_other", "double"), ("byte_share", "double"), ("token_entropy", "double"), ("band", "string"), ("kept", "boolean")]


def measure_text(text: str | None, lang: str | None, fertility: Fertility, bands: dict[str, Band]) -> tuple:
    """The values of RULE_FIELDS for one text; a null text is one without words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))  # white space is ASCII here, so as many bytes as characters
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    repeat = repeated_words(hashes)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    per_token, per_other, share, entropy, pieces = fertility.measure(words, chars)
    name = lang if lang in bands else script_of(text)
    band = bands.get(name) or bands["other"]
    kept = not failed and band.low <= per_token <= band.high and band.low_other <= per_other <= band.high and share <= band.max_byte_share and entropy >= band.min_entropy
    return n, chars, symbols, dup, repeat, failed, pieces, per_token, per_other, share, entropy, name, kept


def fitted_lows(measured: DataFrame) -> DataFrame:
    """For each band and measure of characters per token SPREAD quartile ranges below the median: band, measure, lowest; for making a table of bands, no part of the verdict.

    ``measured`` is what quality_rules returns for a sample. The texts that pass enter a histogram in steps of 0.01, which stays small whatever the sample.
    """
    measures = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(c, 2).alias("value")) for c in ("chars_per_token", "chars_per_other")])).alias("m")
    counts = measured.where("kept").select("band", measures).groupBy("band", "m.measure", "m.value").agg(F.count("*").alias("n"))
    of = Window.partitionBy("band", "measure")
    at = counts.withColumns({"below": F.sum("n").over(of.orderBy("value")), "all": F.sum("n").over(of)})
    quarter = {f"q{k}": F.min(F.when(F.col("below") * 4 >= F.col("all") * k, F.col("value"))) for k in (1, 2, 3)}
    q = at.groupBy("band", "measure").agg(*[c.alias(k) for k, c in quarter.items()])
    return q.select("band", "measure", (F.col("q2") - F.greatest(F.col("q3") - F.col("q1"), F.col("q2") * LEAST_RANGE) * SPREAD).alias("lowest"))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", vocabulary: str | None = None, other_vocabulary: str | None = None, bands: dict[str, Band] | None = None, keep_text: bool = False) -> DataFrame:
    """Each row with its counts, fertility, band and verdict (``kept``); the text itself goes unless ``keep_text``.

    A null text counts as empty, and a text without words fails the base rules. A language that is null or without band
    is judged by its text's script. Repeated rows each get a row, an empty table gives none, and other columns
    pass through; columns named like the added ones are an error. One pass without a shuffle.
    """
    path, other = vocabulary or vocabulary_path("piece_bpe_32k.model"), other_vocabulary or vocabulary_path("byte_bpe_50k.tiktoken")
    table = bands or BANDS
    keep = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    names = [f.name for f in keep]
    if clash := set(names) & {n for n, _ in RULE_FIELDS}:
        raise ValueError(f"columns would clash: {sorted(clash)}")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in keep])
    for name, kind in RULE_FIELDS:
        schema = schema.add(name, kind)
    kinds = [f.dataType for f in schema.fields[len(names) :]]
    lang = lang_col if lang_col in docs.columns else None
    arrow = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    types = [arrow[k.simpleString()] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, other) not in _FERTILITY:
            _FERTILITY[path, other] = Fertility(path, other)
        fertility = _FERTILITY[path, other]
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                langs = batch.column(lang).to_pylist() if lang else [None] * batch.num_rows
                rows = [measure_text(t, x, fertility, table) for t, x in zip(batch.column(text_col).to_pylist(), langs, strict=True)]
                new = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + new, names + [n for n, _ in RULE_FIELDS])

    needed = list(dict.fromkeys([*names, text_col, *([lang] if lang else [])]))
    return docs.select(*[f"`{c}`" for c in needed]).mapInArrow(run, schema)
