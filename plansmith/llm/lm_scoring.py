"""Cross-entropy difference: how much likelier a document is under a target model than under a background model.

Both are word bigram models over one vocabulary, the distinct words of all documents and one for words never seen. All documents are counted: those that
are targets in one model, all others in the other. The models are matched: same order, vocabulary and smoothing.

    P1(w)   = (c(w) + ALPHA) / (N + ALPHA * V)
    P(w|v)  = (c(v, w) + MU * P1(w)) / (h(v) + MU)

h(v) is how often v stands before another word, so P1 and P(.|v) sum to one over the V words. A text's first word follows a start. A document's own counts
are taken out of the model that it was counted in before it is scored.

How the counts meet the documents: tasks cut documents into batches of about BATCH_BYTES of text, staged as word numbers. Each batch asks for its distinct
words and pairs, with its own counts, by ranges of their 64-bit hashes. A range's task adds up what all batches have and answers each of them; the answers are
put back together by batch, where the losses of its documents are summed. So a word that is everywhere costs a batch one entry, all tables grow
with the corpus, and only a few sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_path, small_side, stage
from .shingles import mix, word_hashes

ALPHA, MU = 0.1, 4.0
BATCH_BYTES = 4 << 20
#: About so many words and pairs of all batches meet in a range; the number of ranges follows the input.
RANGE_ENTRIES = 1 << 20
_START = np.uint64(0xA0761D6478BD642F)
#: A range's counts: of pairs in targets and background, of words, and of words before another word.
_COUNTS = ["pt", "pb", "wt", "wb", "ht", "hb"]


def pair_keys(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word with the word before it, and the place of that word; texts have n words each, and the first of each follows the start (-1)."""
    before = np.arange(-1, len(words) - 1)
    before[(np.cumsum(n) - n)[n > 0]] = -1
    left = np.where(before < 0, _START, words[before])
    with np.errstate(over="ignore"):
        return mix(mix(left ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + words), before


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as hold the largest."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(k).max)).tobytes()


def _unsmall(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


def _deltas(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte, so that their high bytes, which are zero in crowded ranges, pack well."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _undeltas(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, len(raw) // 8).T).view("<u8").ravel(), dtype=np.uint64)


def _summed(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys in ascending order, the sums of the values over each, and the place of each row among them."""
    found, place = np.unique(keys, return_inverse=True)
    return found, [np.bincount(place, weights=v, minlength=len(found)).astype(np.int64) for v in values], place


def _batches(flagged: DataFrame) -> DataFrame:
    """One row per batch of documents: their ids, sides and lengths, the batch's distinct words' hashes, and all documents' words as numbers among these."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(flagged.schema["id"].dataType)), *T.StructType.fromDDL("target array<boolean>, n array<int>, batch long, words binary, tokens binary, t long, b long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        ids, target, texts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            words, starts = word_hashes(b"\n".join(texts))
            n = np.diff(np.searchsorted(starts, np.cumsum([len(r) + 1 for r in texts])), prepend=0)
            distinct, tokens = np.unique(words, return_inverse=True)
            in_target = int(n[np.array(target, dtype=bool)].sum())
            columns = [pa.array([ids], pa.list_(id_type)), pa.array([target], pa.list_(pa.bool_())), pa.array([n.tolist()], pa.list_(pa.int32())), pa.array([made], pa.int64())]
            columns += [pa.array([x], pa.binary()) for x in (distinct.astype("<u8").tobytes(), _small(tokens))]
            columns += [pa.array([x], pa.int64()) for x in (in_target, int(n.sum()) - in_target)]
            return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i in range(0, batch.num_rows, 500):
                for key, text, side in zip(*(batch.column(c).slice(i, 500).to_pylist() for c in ("id", "text", "is_target")), strict=True):
                    raw = (text or "").encode().lower()
                    if texts and held + len(raw) > BATCH_BYTES:
                        yield close()
                        made += 1
                        ids, target, texts, held = [], [], [], 0
                    ids.append(key)
                    target.append(side)
                    texts.append(raw)
                    held += len(raw) + 1
        if texts:
            yield close()

    return flagged.select("id", "text", "is_target").mapInArrow(run, schema)


class _Batch:
    """A batch's documents as arrays."""

    def __init__(self, target: list[bool], n: list[int], words: bytes, tokens: bytes):
        self.n = np.array(n, dtype=np.int64)
        self.words = np.frombuffer(words, dtype="<u8")
        self.tokens = _unsmall(tokens, int(self.n.sum()))
        self.doc = np.repeat(np.arange(len(n)), self.n)
        self.target = np.array(target, dtype=bool)
        self.last = np.cumsum(self.n)[self.n > 0] - 1
        self.pairs, self.before = pair_keys(self.words[self.tokens], self.n)
        self.start = int(np.searchsorted(self.words, _START))  # the start's place among the words


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)


def _asked(batches: DataFrame, bits: int) -> DataFrame:
    """What each batch has in each range: distinct pairs and words, with its counts of them."""
    names = ["range", "batch", "pairs", "words", *_COUNTS]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for several in rows:
            for i, batch in enumerate(several.column(0).to_pylist()):
                x = _Batch(*(several.column(k)[i].as_py() for k in range(1, 5)))
                side = x.target[x.doc]
                pairs, (pt, pb), _ = _summed(x.pairs, [side, ~side])
                count = [np.bincount(x.tokens[s], minlength=len(x.words)) for s in (side, ~side)]
                before = [c - np.bincount(x.tokens[x.last[s[x.last]]], minlength=len(x.words)) for c, s in zip(count, (side, ~side), strict=True)]
                begun = [int((s & (x.n > 0)).sum()) for s in (x.target, ~x.target)]
                words = np.insert(x.words, x.start, _START)
                values = [np.insert(v, x.start, extra) for v, extra in zip([*count, *before], [0, 0, *begun], strict=True)]
                p_of, w_of = _ranges(pairs, bits), _ranges(words, bits)
                out = []
                for r in np.union1d(p_of, w_of).tolist():
                    p, w = (slice(*np.searchsorted(of, [r, r + 1])) for of in (p_of, w_of))
                    out.append((r, batch, _deltas(pairs[p]), _deltas(words[w]), _small(pt[p]), _small(pb[p]), *(_small(v[w]) for v in values)))
                for k in range(0, len(out), 256):
                    columns = [*zip(*out[k : k + 256], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])], names)

    return batches.select("batch", "target", "n", "words", "tokens").mapInArrow(run, "range int, batch long, " + ", ".join(f"{c} binary" for c in names[2:]))


def _answered(asked: DataFrame) -> DataFrame:
    """For each batch and range the sums over all batches, in the order of the batch's keys; one row of a range has its number of distinct words."""
    names = ["batch", "range", *_COUNTS, "distinct"]

    def answer(cells: list[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[list[bytes]] = [[] for _ in cells]
        distinct = 0
        for key_at, counts_at in ((2, (4, 5)), (3, (6, 7, 8, 9))):
            keys = [_undeltas(c[key_at]) for c in cells]
            sizes = [len(k) for k in keys]
            values = [np.concatenate([_unsmall(c[k], n) for c, n in zip(cells, sizes, strict=True)]) for k in counts_at]
            found, sums, place = _summed(np.concatenate(keys), values)
            distinct = len(found) - int((found == _START).any()) if key_at == 3 else 0
            for cell, at in zip(out, np.split(place, np.cumsum(sizes)[:-1]), strict=True):
                cell.extend(_small(s[at]) for s in sums)
        for k in range(0, len(cells), 256):
            part = range(k, min(k + 256, len(cells)))
            columns = [pa.array([cells[i][1] for i in part], pa.int64()), pa.array([cells[i][0] for i in part], pa.int32()), *(pa.array([out[i][j] for i in part], pa.binary()) for j in range(6))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([distinct if i == 0 else 0 for i in part], pa.int64())], names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[tuple] = []
        for several in rows:
            for cell in zip(*(c.to_pylist() for c in several.columns), strict=True):
                if cells and cells[0][0] != cell[0]:
                    yield from answer(cells)
                    cells = []
                cells.append(cell)
        if cells:
            yield from answer(cells)

    return asked.repartition("range").sortWithinPartitions("range", "batch").mapInArrow(run, "batch long, range int, " + ", ".join(f"{c} binary" for c in _COUNTS) + ", distinct long")


def losses(x: _Batch, counts: dict[str, np.ndarray], totals: dict[str, int], v: int) -> dict[str, np.ndarray]:
    """The sum of negative log probabilities of each document under either model, its own counts taken out of its own.

    ``counts``: of the batch's distinct pairs (pt, pb) and words with the start among them (wt, wb, ht, hb), over all documents.
    """
    _, _, place = _summed(x.pairs, [])
    word = x.tokens + (x.tokens >= x.start)  # the start lies among the words
    left = np.where(x.before < 0, x.start, word[x.before])
    ends = np.zeros(len(word), dtype=bool)
    ends[x.last] = True
    width = len(x.words) + 1

    def own(keys: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        return n[at] if weight is None else np.bincount(at, weights=weight)[at].astype(np.int64)

    own_pair = own(x.doc * max(1, len(counts["pt"])) + place)
    own_word = own(x.doc * width + word)
    before = own(x.doc * width + word, ~ends)
    own_left = np.where(x.before < 0, 1, before[x.before])
    out = {}
    for side, p, w, h in (("t", "pt", "wt", "ht"), ("b", "pb", "wb", "hb")):
        mine = (x.target if side == "t" else ~x.target)[x.doc]
        first = (counts[w][word] - mine * own_word + ALPHA) / (totals[side] - mine * x.n[x.doc] + ALPHA * v)
        loss = -np.log((counts[p][place] - mine * own_pair + MU * first) / (counts[h][left] - mine * own_left + MU))
        out[side] = np.bincount(x.doc, weights=loss, minlength=len(x.n)).astype(np.float64)  # without words they are of integers
    return out


def _scored(batches: DataFrame, answers: DataFrame, id_type: T.DataType, totals: dict[str, int], v: int) -> DataFrame:
    empty = {c: F.lit(None).cast(k) for c, k in {**{f.name: f.dataType for f in batches.schema.fields}, **{f.name: f.dataType for f in answers.schema.fields}}.items() if c not in ("batch", "range")}
    order = ["batch", "range", "ids", "target", "n", "words", "tokens", *_COUNTS]
    heads = batches.withColumn("range", F.lit(-1)).withColumns({c: empty[c] for c in _COUNTS}).select(*order)
    rows = heads.unionByName(answers.withColumns({c: empty[c] for c in ("ids", "target", "n", "words", "tokens")}).select(*order))
    schema = T.StructType().add("id", id_type).add("n_words", "long").add("is_target", "boolean").add("t", "double").add("b", "double")

    def run(several: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, cells = None, None, []

        def close() -> Iterator[pa.RecordBatch]:
            n_pairs, n_words = len(np.unique(x.pairs)), len(x.words) + 1
            counts = {}
            for k, c in enumerate(_COUNTS):
                counts[c] = np.concatenate([_unsmall(cell[k], cell[6 if k < 2 else 7]) for cell in cells])
                assert len(counts[c]) == (n_pairs if k < 2 else n_words)
            found = losses(x, counts, totals, v)
            columns = [ids, pa.array(x.n), pa.array(x.target), pa.array(found["t"]), pa.array(found["b"])]
            for i in range(0, len(x.n), 5000):
                yield pa.RecordBatch.from_arrays([c[i : i + 5000] for c in columns], schema.fieldNames())

        bits = (totals["ranges"] - 1).bit_length()
        for batch in several:
            for i in range(batch.num_rows):
                r = batch.column(1)[i].as_py()
                if r < 0:
                    if x is not None:
                        yield from close()
                    x, ids, cells = _Batch(*(batch.column(k)[i].as_py() for k in range(3, 7))), batch.column(2)[i].values, []
                    p_of, w_of = _ranges(np.unique(x.pairs), bits), _ranges(np.insert(x.words, x.start, _START), bits)
                else:
                    sizes = [int(np.diff(np.searchsorted(of, [r, r + 1]))[0]) for of in (p_of, w_of)]
                    cells.append((*(batch.column(k)[i].as_py() for k in range(7, 13)), *sizes))
        if x is not None:
            yield from close()

    return rows.repartition("batch").sortWithinPartitions("batch", "range").mapInArrow(run, schema)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_words``, ``is_target``, ``target_loss`` and ``background_loss`` per word in nats, and
    ``score``, their difference: the lower, the more like the targets.

    Words are runs of characters other than ASCII white space with A-Z in lower case, known by 64-bit hashes.
    ``targets`` has the ids of the target documents in ``id_col``; repeats and null ids in it count for nothing. A document without
    words, or with a null text, has null losses and score. Rows that repeat an id are all counted and scored; one
    without id is background. Without targets, or without background, that model knows its smoothing only. An empty table gives no rows.
    """
    if id_col in (added := ("n_words", "is_target", "target_loss", "background_loss", "score")):
        raise ValueError(f"columns would clash: {id_col} is one of {added}")
    key = F.col(f"`{id_col}`")
    spark = docs.sparkSession
    wanted, wanted_path = stage(targets.select(key.alias("_target")).where(F.col("_target").isNotNull()).distinct(), "targets")
    wide = F.octet_length(F.col("_target").cast("string")).cast("long") + 24
    wanted = small_side(wanted, wide)  # few ids are sent to the texts; many meet them in a shuffled join
    rows = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text"))
    flagged = rows.join(wanted, F.col("id") == F.col("_target"), "left").select("id", "text", F.col("_target").isNotNull().alias("is_target"))
    batches, batches_path = stage(_batches(flagged), "batches")
    sums = batches.agg(F.sum("t").alias("t"), F.sum("b").alias("b")).first()
    totals = {"t": sums["t"] or 0, "b": sums["b"] or 0}
    bits = max(0, ((totals["t"] + totals["b"]) // RANGE_ENTRIES).bit_length())
    totals["ranges"] = 1 << bits
    answers, answers_path = stage(_answered(_asked(batches, bits)), "answers")
    v = 1 + (answers.agg(F.sum("distinct")).first()[0] or 0)
    scored, _ = stage(_scored(batches, answers, docs.schema[id_col].dataType, totals, v), "scores")
    for p in (wanted_path, batches_path, answers_path):
        drop_path(spark, p)
    t, b = F.col("t") / F.col("n_words"), F.col("b") / F.col("n_words")
    some = F.col("n_words") > 0
    return scored.select(F.col("id").alias(id_col), "n_words", "is_target", F.when(some, t).alias("target_loss"), F.when(some, b).alias("background_loss"), F.when(some, t - b).alias("score"))
