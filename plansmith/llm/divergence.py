"""Source divergence audit: how far the word use of each source of a language lies from every other's and from the language's, term by term.

Shares are exact whole numbers: p = 1 + floor(10^9 * (n + 1) / (N + V)) for a term that a source has n times, N such terms in all, V kept terms of the language. The divergence of
shares p from q is the sum over terms of floor((p - q)^2 / q).

Tasks count terms of documents and add them up; a term that stays meets its counts of all sources in one row. The rows of a language
are dealt into blocks of terms. A block is a dense tile, sources by terms, of 64-bit integers; all pairs of its sources are compared by broadcasting one source's row over the tile. Blocks give partial
pair matrices, which are summed, and the best terms of each source, which are merged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, small_side, stage

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
MIN_DOCS, TOP_TERMS = 3, 200
#: Cells of a tile (8 bytes each, and as much three times over while pairs are compared), and distinct terms that a task holds before it gives its counts away.
TILE_CELLS, HELD = 1 << 20, 400_000
_SLICE = 1 << 20
_OUT = "part string, source string, item string, value long"


def _terms(raw: bytes) -> Iterator[list[str]]:
    """The text's terms, about a megabyte of it at a time, cut at a byte that is in no term."""
    raw, at = raw.lower(), 0  # of bytes: only A-Z change
    while at < len(raw):
        end = len(raw)
        if end - at > _SLICE:
            end = next((m.end() for m in _BETWEEN.finditer(raw, at + _SLICE)), end)
        yield TERM.findall(raw[at:end].decode())
        at = end


_BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def _counted(rows: DataFrame) -> DataFrame:
    """Terms of each (lang, source) with how often and in how many documents they are: partial sums of tasks."""
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in found.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    some = terms[i : i + 50_000]
                    columns = [pa.array([x] * len(some), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(some, pa.string()), *(pa.array([c[t] for t in some], pa.int64()) for c in (n, docs))], names)

        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                for lang, source, text in zip(*(batch.column(c).slice(i, 200).to_pylist() for c in names[:2] + ["text"]), strict=True):
                    n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                    before, own = len(n), set()
                    for terms in _terms(text.encode()):
                        n.update(terms)
                        own.update(terms)
                    docs.update(own)
                    held += len(n) - before
                    if held > HELD:
                        yield from out()
                        found, held = {}, 0
        yield from out()

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(n: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 * (n + 1) / (total + kept)) by long division in steps of a thousand: exact while total + kept is below 9 * 10^15."""
    by = np.asarray(total, dtype=np.int64) + kept
    rest, out = n.astype(np.int64) + 1, np.zeros(np.broadcast(n, by).shape, dtype=np.int64)
    whole = rest // by
    rest = rest - whole * by
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // by
        rest = rest % by
    return whole * 1_000_000_000 + out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q), term by term; shares are at most 10^9 + 1, so squares fit."""
    d = p - q
    return d * d // q


def tile_pairs(p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a tile its sums of divergence from all rows."""
    for i in range(len(p)):
        yield i, divergence(p[i], p).sum(axis=1)


def best_terms(value: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest values (those above zero places given as -1 are left out), highest first, ties by place."""
    at = np.flatnonzero(value >= 0)
    if len(at) > top:
        least = np.partition(value[at], len(at) - top)[len(at) - top]
        at = at[value[at] >= least]
    return at[np.lexsort((at, -value[at]))][:top]


def _tile(top: int):
    names = ["part", "source", "item", "value"]

    def run(terms: pa.Table, groups: pa.Table) -> pa.Table:
        sources = groups.column("source").to_pylist()
        place = {s: i for i, s in enumerate(sources)}
        totals = np.array(groups.column("n").to_pylist(), dtype=np.int64).reshape(-1, 1)
        words, of, counts = (terms.column(c).to_pylist() for c in ("term", "sources", "counts"))
        order = sorted(range(len(words)), key=lambda i: words[i].encode())
        n = np.zeros((len(sources), len(words)), dtype=np.int64)
        for at, i in enumerate(order):
            n[[place[s] for s in of[i]], at] = counts[i]
        kept, all_n = (groups.column(c)[0].as_py() for c in ("kept", "lang_n"))
        parts: list[tuple[list[str], list[str], list[str], list[int]]] = []
        p = shares(n, totals, kept) if words else n
        for i, sums in tile_pairs(p):
            others = [j for j in range(len(sources)) if j != i]
            parts.append((["pair"] * len(others), [sources[i]] * len(others), [sources[j] for j in others], sums[others].tolist()))
        if words:
            q = shares(np.array([sum(counts[i]) for i in order], dtype=np.int64), all_n, kept)
            for i, source in enumerate(sources):
                value = np.where((n[i] > 0) & (p[i] > q), divergence(p[i], q), -1)
                best = best_terms(value, top)
                parts.append((["term"] * len(best), [source] * len(best), [words[order[j]] for j in best.tolist()], value[best].tolist()))
        columns = [[x for part in parts for x in part[k]] for k in range(4)]
        lang = groups.column("lang")[0].as_py()
        arrays = [pa.array([lang] * len(columns[0]), pa.string()), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True))]
        return pa.Table.from_arrays(arrays, ["lang", *names])

    return run


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, tile_cells: int = TILE_CELLS) -> DataFrame:
    """For each source of each language: its divergence from every other source (``part`` = 'pair', ``item`` the other, all ranks) and the terms that it uses more than
    the language does (``part`` = 'term', ranks to ``top_terms``). Columns lang, source, part, item, value, rank.

    Terms are runs of letters A-Z, in lower case, and of characters beyond ASCII; a language keeps those in at least ``min_docs`` of its documents (rows). Null
    languages, sources and texts count as ''. Sources without terms are compared too; in a language without kept terms all pairs have value 0. Ties go to the
    smaller item in UTF-8. Repeated rows count each; an empty table gives no rows. A language's only source has no pairs.
    Values are exact while a language has below 9 * 10^15 kept words and 10^9 kept terms.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    sums, sums_path = stage(_counted(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    by_term = sums.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("of"), F.sum("docs").alias("docs"))
    terms, terms_path = stage(by_term.where(F.col("docs") >= min_docs).select("lang", "term", F.col("of.source").alias("sources"), F.col("of.n").alias("counts")), "terms")
    drop_path(spark, sums_path)
    per_source = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = rows.select("lang", "source").distinct().join(per_source, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    groups, groups_path = stage(groups, "groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("of"), F.sum("n").alias("lang_n")).join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    langs, langs_path = stage(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("of") / tile_cells)).cast("int")).drop("of"), "langs")
    wide = F.octet_length("lang").cast("long") + 32
    dealt = terms.join(small_side(langs.select("lang", "blocks"), wide), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int")).drop("blocks")
    beside = groups.join(small_side(langs, wide), "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    tiles = dealt.groupBy("lang", "block").cogroup(beside.groupBy("lang", "block")).applyInArrow(_tile(top_terms), f"lang string, {_OUT}")
    tiles, _ = stage(tiles, "tiles")
    for p in (terms_path, groups_path, langs_path):
        drop_path(spark, p)
    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    best = tiles.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
