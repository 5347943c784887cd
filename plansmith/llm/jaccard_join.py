"""Exact n-gram Jaccard join of whole documents by size-banded tiles and hashed bitmap signatures.

1. A pass over the texts counts shingles in a sketch of fixed size. It only fixes an order: shingles that many texts share come last.
2. A second pass gives each document its distinct shingles' hash (the class: copies are one node), their number, a hashed
   bitmap, and the first shingles in that order. Two sets of Jaccard similarity t share one of the first
   ``n - ceil(t n) + 1`` of each, whatever the order; as common shingles come last, few documents meet in one by chance.
3. Classes that meet no other there are done. The others' sets are staged once.
4. Classes that look alike are gathered in families: each class and the one that it meets most often, of those that lead a shingle, if bitmaps
   leave the pair open. Bitmaps bound the overlap from above: a bit that only one side has is an element that the other lacks. These pairs are
   intersected first, as sorted arrays. Where that joins a whole family it is done. In the others the largest group stays as it is, and the strays meet each other
   and that group in tiles of bounded size, so sets are copied as often as strays fill tiles;
   pairs that are linked through others by then are skipped, as their link changes no group.
5. Where classes of different families meet, tiles of one shingle and size band compare all of those pairs, by bitmaps, wider
   bitmaps, and then exactly. Families only say where a pair is compared. Large tiles are split in blocks and pairs of blocks.
No pair at or above the threshold is lost but those whose ends are linked otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, drop_path, small_side, stage
from .counts import SCHEMA, gather, slices
from .shingles import shingle_lists, shingle_sets

SKETCH_BITS = 20
TILE_ROWS = 4096
FOLLOWERS = 512
FAMILY_ROWS = 2048
#: Nor more than about so many bytes of hashes in a block, so that a tile of two blocks of long texts fits in a worker.
FAMILY_BYTES = 32 << 20
TURNS, MORE_TURNS = 2, 6
ROW_BITS = 2048
WIDE = 4


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles of n suffice to meet every set of so high a similarity."""
    return n + (-percent * n) // 100 + 1 if n else 0


def bitmap(hashes: np.ndarray, spread: int = 1, most: int = 1 << 62) -> bytes:
    """A bit for each hash, in a width that is a power of two from 64 to ``most`` and else about ``spread`` times the number of hashes."""
    bits = min(most, max(64, 1 << (max(spread * len(hashes), 1) - 1).bit_length()))
    out = np.zeros(bits, dtype=np.uint8)
    out[(hashes >> np.uint64(11)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(map_: np.ndarray, width: int) -> np.ndarray:
    """The bitmap of the same hashes in fewer words of 64 bits."""
    return np.bitwise_or.reduce(map_.reshape(-1, width), axis=0)


def overlap_bound(n: np.ndarray, maps: np.ndarray, m: int, one: np.ndarray) -> np.ndarray:
    """For each of many bitmaps (rows of 64-bit words, of sets of n elements) the most that its set can share with one of m elements."""
    only = np.bitwise_count(maps & ~one).sum(axis=1, dtype=np.int64)
    other = np.bitwise_count(one & ~maps).sum(axis=1, dtype=np.int64)
    return np.minimum(n - only, m - other)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _sketch(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """Counts of all shingles by their top bits: of a fixed size, whatever the input."""
    cells = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                found = [*shingle_lists(batch.column(0).slice(i, 500).to_pylist(), size)]
                total += np.bincount((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
        yield from slices(total)

    return gather(docs.select(f"`{text_col}`").mapInArrow(run, SCHEMA), cells)


def _class_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def _signatures(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """One row a document: id, number of distinct shingles, class, and, at a task's first row of the class, its first shingles and bitmap."""
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL("n long, cls long, first array<long>, bits binary").fields])
    order = np.minimum(sketch, (1 << 20) - 1).astype(np.uint64) << np.uint64(44)

    none = np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                n, cls, firsts, bits = [], [], [], []
                for key, h in zip(batch.column(0).is_valid().to_pylist(), shingle_sets(batch.column(1).to_pylist(), size), strict=True):
                    n.append(len(h))
                    cls.append(_class_of(h) if len(h) else None)
                    if not len(h) or not key or cls[-1] in seen:
                        firsts.append(none)
                        bits.append(None)
                        continue
                    seen.add(cls[-1])
                    k = prefix_length(len(h), percent)
                    rank = order[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] | ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20))
                    firsts.append(h[np.argsort(rank, kind="stable")[:k]].view(np.int64))
                    bits.append(bitmap(h, 1, ROW_BITS))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
                flat = np.concatenate(firsts) if firsts else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(bits, pa.binary())], schema.fieldNames())

    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """The whole sets and wide bitmaps of the wanted classes (columns ``rep`` and ``cls``), from the texts of their first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                batch = whole.slice(i, 200)
                found = [*shingle_sets(batch.column(1).to_pylist(), size)]
                right = [k for k, (c, h) in enumerate(zip(batch.column(0).to_pylist(), found, strict=True)) if len(h) and _class_of(h) == c]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(right, pa.int64())), pa.array([found[k].tobytes() for k in right], pa.binary()), pa.array([bitmap(found[k], WIDE) for k in right], pa.binary())], ["cls", "items", "wide"])

    texts = docs.select(F.col(f"`{id_col}`").alias("rep"), F.col(f"`{text_col}`").alias("text")).join(small_side(wanted, F.octet_length(F.col("rep").cast("string")).cast("long") + 40), "rep").select("cls", "text")
    return texts.mapInArrow(run, "cls long, items binary, wide binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets reach the similarity.

    Every b is sent once to each block of at most about FOLLOWERS of its a, which then pass by it one at a time.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(FOLLOWERS)).cast("int").alias("blocks"))
    dealt = pairs.join(many, "b").select("b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), "a")
    members = dealt.select("b", "block", F.lit(1).alias("role"), F.col("a").alias("cls")).unionAll(dealt.select("b", "block", F.lit(0), F.col("b")).distinct())
    members, _ = stage(members, "members")
    met = sets.join(small_side(members, 60), "cls").select("b", "block", "role", "cls", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, items = None, None
        for batch in batches:
            a, b = [], []
            for g, block, role, cls, raw in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                x = np.frombuffer(raw.as_py(), dtype="<u8")
                if role == 0:
                    lead, items = (g, block), x
                elif lead == (g, block) and similar(x, items, percent):
                    a.append(cls)
                    b.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.repartition("b", "block").sortWithinPartitions("b", "block", "role").mapInArrow(run, "a long, b long")


def _bounded(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that the bitmaps can't rule out. ``maps``: cls, n and bits of every class in them."""
    maps = small_side(maps, F.octet_length("bits").cast("long") + 60)
    left = maps.select(F.col("cls").alias("a"), "n", F.col("bits").alias("x"))
    right = maps.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    both = pairs.join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            good = []
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8")
                w = min(len(x), len(y))
                most = int(overlap_bound(n[i : i + 1], fold(x, w)[None, :], int(m[i]), fold(y, w))[0])
                good.append(100 * most >= percent * (int(n[i]) + int(m[i]) - most))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def _lead_pairs(rows: DataFrame, turns: int) -> DataFrame:
    """For each class of ``rows`` (h, cls) and each turn one class that it meets, as distinct pairs (a, b).

    At each h the classes are ordered by a hash that changes with the turn, and the first leads. Of a turn's leaders a class takes the one that
    it has at most shingles, so the one that it shares most with.
    """
    leads = rows.groupBy("h").agg(F.array(*[F.min_by("cls", F.xxhash64("cls", F.lit(t))) for t in range(turns)]).alias("leads"))
    met = rows.join(leads, "h").select(F.col("cls").alias("a"), F.posexplode("leads").alias("turn", "b")).where("a != b")
    times = met.groupBy("a", "turn", "b").agg(F.count("*").alias("times"))
    return times.groupBy("a", "turn").agg(F.max_by("b", F.struct("times", F.xxhash64("b"))).alias("b")).select("a", "b").distinct()


def family_links(sets: list[tuple[int, np.ndarray]], own: np.ndarray | None, percent: int, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the similar ones of some sets (class, sorted hashes): as few as keep all of their groups whole.

    ``own``: the block of each set; pairs within a block are left out then. ``groups``: sets of equal numbers are linked already.
    """
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k][1]), sets[k][0]))
    n = np.array([len(sets[k][1]) for k in order], dtype=np.int64)
    blocks = None if own is None else own[order]
    maps = [np.frombuffer(bitmap(sets[k][1], WIDE), dtype="<u8") for k in order]
    cuts = [0, *(k for k in range(1, len(maps)) if len(maps[k]) != len(maps[k - 1])), len(maps)]
    stacked = [(a, b, np.stack(maps[a:b])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]  # sizes ascend, so widths do
    group = np.arange(len(order)) if groups is None else np.unique(np.array(groups, dtype=np.int64)[order], return_inverse=True)[1]
    links = []
    for y in range(len(order)):
        first = int(np.searchsorted(n, -(-percent * n[y] // 100)))
        open_ = group[first:y] != group[y]
        if blocks is not None:
            open_ &= blocks[first:y] != blocks[y]
        x = first + np.flatnonzero(open_)
        for a, b, rows in stacked:
            some = x[(x >= a) & (x < b)]
            if not len(some):
                continue
            most = overlap_bound(n[some], rows[some - a], int(n[y]), fold(maps[y], rows.shape[1]))
            some = some[100 * most >= percent * (n[some] + n[y] - most)]
            for k in some[::-1].tolist():
                if group[k] != group[y] and similar(sets[order[k]][1], sets[order[y]][1], percent):
                    links.append((sets[order[k]][0], sets[order[y]][0]))
                    group[group == group[y]] = group[k]
    return links


def _strays(families: DataFrame, groups: DataFrame) -> DataFrame:
    """The classes of families that hold more than one group (``families``: cls, family; ``groups``: node, component): cls, family, label, and
    whether the class is a stray, outside its family's largest group."""
    labelled = families.join(small_side(groups, 24), F.col("cls") == F.col("node"), "left").select("cls", "family", F.coalesce("component", "cls").alias("label"))
    labelled, _ = stage(labelled, "labelled")
    sizes = labelled.groupBy("family", "label").agg(F.count("*").alias("n"))
    largest, _ = stage(sizes.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("groups")).where("groups > 1").select("family", "largest"), "largest")
    return labelled.join(small_side(largest, 24), "family").select("cls", "family", "label", (F.col("label") != F.col("largest")).alias("stray"))


def _within_families(strays: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes of one family and different groups. Strays (with ``n``, the size of the set) and others are dealt to blocks by number and bytes; each pair of blocks with strays is a tile."""

    def blocks(stray: bool) -> Column:
        mine = F.col("stray") == stray
        return F.ceil(F.greatest(F.count_if(mine) / F.lit(FAMILY_ROWS), F.coalesce(F.sum(F.when(mine, F.col("n") * 8)), F.lit(0)) / F.lit(FAMILY_BYTES))).cast("int")

    sizes, _ = stage(strays.groupBy("family").agg(blocks(True).alias("stray_blocks"), blocks(False).alias("other_blocks")), "sizes")
    dealt = strays.join(small_side(sizes, 24), "family")
    own = F.when(F.col("stray"), F.pmod(F.xxhash64("cls"), F.col("stray_blocks"))).otherwise(F.col("stray_blocks") + F.pmod(F.xxhash64("cls"), F.col("other_blocks"))).cast("int")
    last = F.when(F.col("stray"), F.col("stray_blocks") + F.col("other_blocks")).otherwise(F.col("stray_blocks")) - 1
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt, _ = stage(dealt.select("cls", "family", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")), "families")
    rows = sets.select("cls", "items").join(small_side(dealt, 60), "cls").select("family", "i", "j", "own", "label", "cls", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, own, labels = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                found = family_links(held, np.array(own) if key[1] != key[2] else None, percent, labels)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for family, i, j, block, label, cls, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, i, j) != key:
                    yield from close()
                    key, held, own, labels = (family, i, j), [], [], []
                held.append((cls, np.frombuffer(raw, dtype="<u8")))
                own.append(block)
                labels.append(label)
        yield from close()

    return rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "cls").mapInArrow(run, "a long, b long")


def _tile_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups within each tile that sizes and bitmaps can't rule out.

    ``rows``: h, cls, n, label, bits and ``met``, the number of classes at h. A tile is a shingle and a size band of one ``percent``
    step; a class goes to its own band and to the next one, where it meets the larger sets. A shingle with more than TILE_ROWS
    classes is dealt to blocks, and each pair of blocks is a tile of its own.
    """
    step = float(np.log(100 / percent)) if percent < 100 else 1.0
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(1e-9)).cast("int")
    blocks = F.ceil(F.col("met") / F.lit(TILE_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    tiled = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiled = tiled.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("own_band", band)
    tiled = tiled.select("h", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "n", "label", "bits", "own", "own_band")
    keys = ["h", "band", "i", "j"]

    def pairs_of(tile: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(tile) < 2:
            return
        cls, n, label = (np.array([r[k] for r in tile], dtype=np.int64) for k in (4, 5, 6))
        own, home = np.array([r[8] for r in tile]), np.array([r[9] == r[1] for r in tile])
        maps = [np.frombuffer(r[7], dtype="<u8") for r in tile]
        width = min(map(len, maps))
        maps = np.stack([fold(x, width) for x in maps])
        across = tile[0][2] != tile[0][3]
        for y in np.flatnonzero(home):  # the larger set is at home here; of equal sizes the larger class
            fits = (label != label[y]) & (100 * n >= percent * n[y]) & ((n < n[y]) | ((n == n[y]) & (cls < cls[y])))
            if across:
                fits &= own != own[y]
            x = np.flatnonzero(fits)
            if len(x):
                most = overlap_bound(n[x], maps[x], int(n[y]), maps[y])
                x = x[100 * most >= percent * (n[x] + n[y] - most)]
            if len(x):
                a, b = np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != key:
                    yield from pairs_of(tile)
                    key, tile = row[:4], []
                tile.append(row)
        yield from pairs_of(tile)

    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id_col``, ``n_shingles`` and ``component_id``, the smallest id that it reaches by links.

    Two documents link when 100 times the size of their sets' intersection is at least ``percent`` times that of the union. A set
    is the distinct runs of ``size`` words (A-Z in lower case, parted by ASCII white space) of the whole text; fewer
    words are one run. A document without words, or with a null text, has an empty set and links with nothing: its component is itself. Copies
    are one node, so any number of them costs one. Rows that repeat an id each give a row; one without id
    has no component. An empty table gives no rows, and other columns are not read. Shingles and sets are known by 64-bit hashes.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    if id_col in ("n_shingles", "component_id"):
        raise ValueError(f"columns would clash: {id_col}")
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))  # names of the caller can't meet ours
    named, id_col, text_col = id_col, "_id", "_text"
    signed, signed_path = stage(_signatures(docs, id_col, text_col, size, percent, _sketch(docs, text_col, size)), "signatures")
    key = F.col(f"`{id_col}`")
    reps, reps_path = stage(signed.where(F.col("cls").isNotNull() & key.isNotNull()).groupBy("cls").agg(F.min(key).alias("rep")), "classes")
    firsts = signed.select(F.explode("first").alias("h"), "cls")
    shared, shared_path = stage(firsts.groupBy("h").agg(F.count("*").alias("met"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("h", "met"), "shared")
    met, met_path = stage(firsts.join(small_side(shared, 32), "h").select("h", "cls", "met").distinct(), "met")
    drop_path(docs.sparkSession, shared_path)
    wanted, wanted_path = stage(met.select("cls").distinct(), "wanted")
    known = signed.where(F.col("bits").isNotNull()).select("cls", "n", "bits").join(small_side(wanted, 40), "cls", "left_semi").dropDuplicates(["cls"])
    known, known_path = stage(known.join(reps, "cls").select("cls", "rep", "n", "bits"), "known")
    slim, _ = stage(signed.select(key, "n", "cls"), "sizes")
    spark, paths = docs.sparkSession, []
    drop_path(spark, signed_path)  # first shingles and bitmaps are the bulk of what is staged

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = stage(df, name)
        paths.append(path)
        return out

    def drop_kept() -> None:
        for p in paths:
            drop_path(spark, p)
        paths.clear()

    def sets_of(wanted: DataFrame) -> DataFrame:
        reps_of = kept(known.select("cls", "rep").join(small_side(wanted, 40), "cls", "left_semi"), "wanted")
        return kept(_sets(docs, id_col, text_col, size, reps_of).dropDuplicates(["cls"]), "sets")

    def families_of(alike: DataFrame) -> DataFrame:
        return kept(connected_components(alike).select(F.col("node").alias("cls"), F.col("component").alias("family")), "families")

    def open_rows(families: DataFrame) -> DataFrame:
        """The rows of shingles where classes of different families meet."""
        labelled = met.join(small_side(families, 40), "cls", "left").select("h", "cls", "met", F.coalesce("family", "cls").alias("label"))
        mixed = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("h")
        return kept(labelled.join(mixed, "h", "left_semi"), "open")

    alike = kept(_bounded(_lead_pairs(met, TURNS), known, percent), "alike")
    alike = alike.unionByName(kept(_bounded(_lead_pairs(open_rows(families_of(alike)), MORE_TURNS), known, percent), "alike"))
    families, families_path = stage(families_of(alike), "families")
    sets = sets_of(families.select("cls"))
    led, led_path = stage(_verify(alike.distinct(), sets, percent), "links")
    strays = kept(_strays(families, kept(connected_components(led), "groups")).join(known.select("cls", "n"), "cls"), "strays")
    links, links_path = stage(_within_families(strays, sets, percent), "links")
    links = links.unionByName(led)
    drop_kept()
    # tiles where classes of different families meet
    rows = open_rows(families).join(known.select("cls", "n", "bits").hint("merge"), "cls")  # sorted by class, equal bitmaps pack well
    more = kept(_tile_pairs(rows, percent), "pairs")
    more_sets = sets_of(kept(more.select(F.col("a").alias("cls")).unionAll(more.select("b")).distinct(), "wanted"))
    wide = kept(more_sets.join(known.select("cls", "n"), "cls").select("cls", "n", F.col("wide").alias("bits")), "wide")
    more = kept(_bounded(more, wide, percent), "pairs")
    links2 = kept(_verify(more, more_sets, percent), "links")
    every = connected_components(links.unionByName(links2))
    labels = reps.join(every, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("component", "cls").alias("group"))
    lowest = labels.groupBy("group").agg(F.min("rep").alias("component_id"))
    of_class, _ = stage(labels.join(lowest, "group").select("cls", "component_id"), "labels")
    drop_kept()
    for p in (reps_path, wanted_path, met_path, known_path, families_path, led_path, links_path):
        drop_path(spark, p)
    return slim.select(key, F.col("n").alias("n_shingles"), "cls").join(of_class, "cls", "left").select(key.alias(named), "n_shingles", F.when(key.isNotNull(), F.coalesce("component_id", key)).alias("component_id"))
