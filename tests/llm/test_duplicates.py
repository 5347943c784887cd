"""Line dedup and the Jaccard join against brute force."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansmith.llm import jaccard_join
from plansmith.llm.common import connected_components
from plansmith.llm.jaccard_join import bitmap, fold, jaccard_groups, overlap_bound, prefix_length
from plansmith.llm import line_dedup
from plansmith.llm.line_dedup import ARCS, _lines, dedup_lines, with_blocks, words_of
from plansmith.llm.shingles import shingle_sets

from .data import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Groups:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t))
    g = Groups(sets)
    for a, b in combinations(sets, 2):
        for x in sets[a]:
            for y in sets[b]:
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    g.join(a, b)
    return sorted((i, len(s), g.find(i)) for i, l in sets.items() for s in l)


def chain(n):
    """Texts of which neighbours alone are similar."""
    base = [f"w{i}" for i in range(100)]
    out = []
    for k in range(n):
        out.append(" ".join(base))
        base = [*base[:-8], *(f"c{k}x{j}" for j in range(8))] if k % 2 else [*(f"d{k}x{j}" for j in range(8)), *base[8:]]
    return out


def test_connected_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    g = Groups({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if a is not None and a != b:
            g.join(a, b)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: g.find(x) for x in linked}
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [4096, 3])
def test_jaccard_groups(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", tile)
    monkeypatch.setattr(jaccard_join, "FOLLOWERS", tile)
    monkeypatch.setattr(jaccard_join, "FAMILY_ROWS", tile)
    monkeypatch.setattr(jaccard_join, "FAMILY_BYTES", 32 << 20 if tile == 4096 else 1000)  # a set of 56 shingles has 448 bytes
    rows = documents() + [(1000 + i, t, "en", "s", 1, "e") for i, t in enumerate(chain(25))]
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(60)]
    for i in range(40):  # a crowd around one text, whose members are at or below the threshold from each other
        near = list(base)
        for k in rng.choice(60, 2, replace=False):
            near[k] = f"n{i}"
        rows.append((2000 + i, " ".join(near), "en", "s", 1, "e"))
    rows.append((2999, " ".join(base), "en", "s", 1, "e"))
    out = jaccard_groups(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None) == brute_groups(rows)
    (none,) = [r for r in out if r["doc_id"] is None]
    assert none["component_id"] is None and none["n_shingles"] > 0
    if tile == 4096:
        assert jaccard_groups(frame(spark, [])).count() == 0


def test_bitmap_bound_and_prefix():
    texts = [r[1] for r in documents()]
    sets = [s for s in shingle_sets(texts) if len(s)]
    for a, b in combinations(sets, 2):
        x, y = np.frombuffer(bitmap(a), "<u8"), np.frombuffer(bitmap(b), "<u8")
        w = min(len(x), len(y))
        most = overlap_bound(np.array([len(a)]), fold(x, w)[None, :], len(b), fold(y, w))[0]
        assert most >= len(np.intersect1d(a, b))
    assert [len(s) for s in shingle_sets(texts)] == [len(shingle_set(t)) for t in texts]
    assert [prefix_length(n, 80) for n in (0, 1, 4, 5, 10, 11)] == [0, 1, 1, 2, 3, 3]


def edit_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def features(line):
    """The features of a normalised line by kind, as tuples of strings, and how many of them vote in a block."""
    words = line.split(" ")
    long_words = [w for w in words if len(w) >= 4]
    n = len(long_words)
    out = []
    if n < 8:
        out.append(({tuple(line[i : i + 3]) for i in range(len(line) - 2)}, 5))
    if 6 <= n < 16:
        out.append(({(w,) for w in long_words}, 3))
    if n >= 12:
        out.append(({(v[-3:], w[:3]) for v, w in zip(long_words, long_words[1:])}, 3))  # noqa: B905
    return out


def brute_blocks(spark, lines):
    """For each line the set of its SimHash blocks: bits counted one by one over the first voters from each arc's start."""
    wanted = sorted({f for x in lines for fs, _ in features(x) for f in fs})
    hashed = {}
    for k in (1, 2, 3):
        some = [f for f in wanted if len(f) == k]
        if some:
            df = spark.createDataFrame(some, ", ".join(f"c{i} string" for i in range(k)))
            hashed.update({tuple(r)[:k]: r["h"] | 1 for r in df.select("*", F.xxhash64(*df.columns).alias("h")).collect()})
    out = {}
    for x in lines:
        out[x] = set()
        for fs, voters in features(x):
            ring = sorted(hashed[f] for f in fs)
            for b in range(ARCS if ring else 0):
                at = sum(h < b * 2**64 // ARCS - 2**63 for h in ring)
                votes = [ring[(at + i) % len(ring)] % 2**64 for i in range(voters)]
                bits = sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in votes) > voters)
                out[x].add(bits - 2**64 if bits >= 2**63 else bits)
    return out


def near(a, b):
    return edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)


def test_line_dedup(spark):
    rows = [r for r in documents() if r[1] is None or len(r[1]) < 9000]
    long_line = " ".join(f"token{i}" for i in range(90))
    variants = [long_line, long_line.replace("token40", "tokem40"), long_line.replace("token80 ", ""), long_line.upper() + "!!", long_line.replace("token1 ", "tokens ").replace("token2 ", "tokez ")]
    rows.append((600, " ".join(f"word{i % 211}" for i in range(700)), "en", "s", 1, "e"))
    rows += [(500 + i, f"unique {i} alpha{i} beta{i}\n{v}\nTail {i * 7919} line of its own {i}", "en", "s", 1, "e") for i, v in enumerate(variants)]
    docs = frame(spark, rows)
    found = {(*r["place"],): " ".join(r["words"]) for r in _lines(docs, "doc_id", "text").collect()}
    blocks = brute_blocks(spark, set(found.values()))
    lines = spark.createDataFrame([(x,) for x in blocks], "norm string").withColumn("words", F.split("norm", " "))
    for r in with_blocks(lines).collect():
        assert len(r["blocks"]) == len(set(r["blocks"])) and set(r["blocks"]) == blocks[r["norm"]]
    g = Groups(set(found.values()))
    for a, b in combinations(sorted(blocks), 2):
        if blocks[a] & blocks[b] and near(a, b):
            g.join(a, b)
    first = {}
    for k, norm in found.items():
        place = (k[0] is not None, k[0] or 0, k[1], k[2])
        label = g.find(norm)
        first[label] = min(first.get(label, place), place)
    keep = set(first.values())
    out = dedup_lines(docs).collect()
    assert len(out) == len(rows)
    of = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    want = []
    for i, t, *_ in rows:
        if t is None:
            want.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        left = [x for k, x in enumerate(lines) if (i, of[i, t], k) not in found or (i is not None, i or 0, of[i, t], k) in keep]
        want.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    assert sorted(map(repr, ((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out))) == sorted(map(repr, want))
    assert sum(w[3] for w in want) > 15
    fuzzy = [g.find(v) for v in set(found.values()) if v.startswith("token0")]
    assert len(fuzzy) > len(set(fuzzy))  # lines that differ are linked too
    assert {r["extra"] for r in out} == {"e", None}
    assert dedup_lines(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(docs.withColumnRenamed("extra", "n_lines"))


def reworded(rng, words, k, pool):
    out = list(words)
    for i in rng.choice(len(words), k, replace=False):
        out[i] = pool[rng.integers(len(pool))]
    return out


def test_line_dedup_recall(spark):
    """Of edited copies within the edit similarity at least nine in ten are found at each length, and lines on other matters stay."""
    rng = np.random.default_rng(11)
    pool = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 11))) for _ in range(4000)]
    lines, pairs = [], {}
    for n, k in ((7, 1), (10, 1), (15, 1), (15, 2), (25, 2), (40, 1), (40, 3), (80, 6), (160, 12), (400, 25)):
        for _ in range(30):
            words = [pool[i] for i in rng.integers(0, len(pool), n)]
            other = reworded(rng, words, k, pool)
            a, b = " ".join(words), " ".join(other)
            if n > 100 or near(a, b):
                pairs.setdefault(n, []).append((len(lines), len(lines) + 1))
                lines += [a, b]
    cjk = ["".join(chr(x) for x in rng.integers(0x4E00, 0x5E00, 40)) for _ in range(20)]
    for x in cjk:
        pairs.setdefault("cjk", []).append((len(lines), len(lines) + 1))
        lines += [x, x[:9] + "\u4e00" + x[10:]]
    out = dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)).collect()
    gone = {r["doc_id"] for r in out if r["n_removed"]}
    for n, some in pairs.items():
        assert len(some) >= 15 and sum(b in gone for _, b in some) >= 0.9 * len(some), n
    assert not gone & {a for some in pairs.values() for a, _ in some}


def mistyped(rng, line, share):
    """The line with so large a share of its letters changed, one at least."""
    out = list(line)
    at = [i for i, c in enumerate(out) if c != " "]
    for i in rng.choice(at, max(1, round(share * len(at))), replace=False):
        out[i] = rng.choice([c for c in "abcdefghijklmnopqrstuvwxyz" if c != out[i]])
    return "".join(out)


def test_line_dedup_recall_of_changed_letters(spark):
    """Against plain edit distance: nearly all lines with a letter changed, and nine in ten with five in a hundred from six words on; lines on other matters stay."""
    rng = np.random.default_rng(13)
    pool = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 11))) for _ in range(4000)]
    lines, pairs = [], {}
    for words, share, least in (((3, 5), 0, 0.8), ((6, 14), 0, 0.9), ((15, 40), 0, 0.9), ((41, 120), 0, 0.9), ((6, 14), 0.05, 0.85), ((15, 40), 0.05, 0.9), ((41, 120), 0.05, 0.9)):
        for _ in range(60):
            a = " ".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(words[0], words[1] + 1)))
            b = mistyped(rng, a, share)
            if sum(x != y for x, y in zip(a, b)) <= int(0.2 * len(a) + 1e-9):  # noqa: B905 (letters are changed in place, so no shorter edit is needed to be near)
                pairs.setdefault((words, share, least), []).append((len(lines), len(lines) + 1))
                lines += [a, b]
    out = dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)).collect()
    gone = {r["doc_id"] for r in out if r["n_removed"]}
    for (words, share, least), some in pairs.items():
        assert len(some) >= 40 and sum(b in gone for _, b in some) >= least * len(some), (words, share, sum(b in gone for _, b in some), len(some))
    assert not gone & {a for some in pairs.values() for a, _ in some}


def test_line_dedup_rounds_and_vast_lines(spark, monkeypatch):
    """A crowd in which many lines share blocks but few are near, and lines compared by words."""
    monkeypatch.setattr(line_dedup, "LETTERS", 300)
    rng = np.random.default_rng(12)
    head = [f"common{i}" for i in range(30)]
    crowd = [" ".join([*head, *(f"own{i}x{j}" for j in range(22))]) for i in range(20)]
    crowd += [" ".join(reworded(rng, x.split(" "), 2, ["other"])) for x in crowd[:5]]
    g = Groups(crowd)
    for a, b in combinations(crowd, 2):
        x, y = a.split(" "), b.split(" ")
        if edit_distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
            g.join(*sorted((a, b)))
    out = dedup_lines(spark.createDataFrame(list(enumerate(crowd)), "doc_id long, text string").repartition(3)).collect()
    assert sum(r["n_removed"] for r in out) == len(crowd) - len({g.find(x) for x in crowd}) == 5
    clash = spark.createDataFrame([(1, "one line here", 2, "x")], "id long, text string, `of` int, `gone` string")
    assert dedup_lines(clash, id_col="id").select("id", "of", "gone", "n_lines").first()[:] == (1, 2, "x", 1)


def test_line_dedup_long_lines_by_letters(spark):
    """Lines of some 5,200 letters count as those of some 3,200 do: many words with one letter changed are near, few words that hold most letters are not."""
    rng = np.random.default_rng(17)
    letters = list("abcdefghiklmnoprstu")
    word = lambda n: "".join(rng.choice(letters, n))
    rows, want = [], {}
    for n in (400, 650):  # a letter of every fourth word, from the middle on: every block has voters that stay
        words = [word(7) for _ in range(n)]
        other = [w[:3] + "z" + w[4:] if i % 4 == 0 else w for i, w in enumerate(words)]
        want[len(rows) + 1] = 1
        rows += [" ".join(words), " ".join(other)]
    for n, size in ((400, 80), (650, 130)):  # a tenth of the words have half of the letters
        words = [word(size // 2) if i % 10 == 0 else word(4) for i in range(n)]
        other = [word(len(w)) if i % 10 == 0 else w for i, w in enumerate(words)]
        want[len(rows) + 1] = 0
        rows += [" ".join(words), " ".join(other)]
    assert [len(x) > 5000 for x in rows[:4]] == [False, False, True, True]
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert {i: got[i] for i in want} == want


def test_words_of(spark):
    rows = spark.createDataFrame([("  Ä-b  C3!",), ("***",), ("",), (None,)], "x string").select(words_of(F.col("x"))).collect()
    assert [r[0] for r in rows] == [["ä", "b", "c3"], [], [], None]


def test_line_dedup_pairs_and_rounds(spark, monkeypatch):
    """Lines that share a block but whose lengths alone part them make no pair, and a crowd in which no two are near is done in few rounds."""
    rng = np.random.default_rng(23)
    word = lambda n: "".join(rng.choice(list("abcdefghiklmnoprstu"), n))
    head = [word(8) for _ in range(60)]
    crowd = [" ".join([*head, *(word(8) for _ in range(30))]) for _ in range(24)]
    lines = [*crowd, " ".join(head), " ".join(head[2:])]
    asked, verified = [], line_dedup._verified

    def seen(pairs, texts, least):
        x, y = (texts.select(F.col("node").alias(c), F.length("norm").alias(f"n{c}")) for c in "ab")
        asked.append(pairs.join(x, "a").join(y, "b").select("na", "nb").collect())
        return verified(pairs, texts, least)

    monkeypatch.setattr(line_dedup, "_verified", seen)
    out = dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)).collect()
    assert [r["doc_id"] for r in out if r["n_removed"]] == [25]
    lengths = [tuple(r) for some in asked for r in some]
    assert len(lengths) > 100 and all(abs(a - b) <= int(0.2 * max(a, b) + 1e-9) for a, b in lengths)
    assert len(asked) <= 5


def test_line_dedup_verifies_by_bounds(spark):
    """Heads, words and narrow bands save comparisons and never change a verdict: edits at either end, words put in, taken out or moved, heads alike and tails not."""
    rng = np.random.default_rng(29)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstuéß"), rng.integers(2, 9)))
    rows = []
    for n in (5, 12, 40, 90):
        for share in (0.05, 0.15, 0.2, 0.25, 0.4):
            x = [word() for _ in range(n)]
            k = max(1, int(share * n))
            at = set(rng.choice(n, k, replace=False).tolist())
            new = [word() for _ in range(k)]
            for y in ([*new, *x[k:]], [*x[:-k], *new], [*new, *x], x[k:], [*x[k:], *x[:k]], [w for i, w in enumerate(x) if i not in at], [word() if i in at else w for i, w in enumerate(x)], [word() for _ in x]):
                rows.append((" ".join(x), " ".join(y)))
            rows.append((" ".join(x), mistyped(rng, " ".join(x), share)))
    rows = [r for r in rows if r[1]]
    texts = spark.createDataFrame([(2 * i + j, t) for i, r in enumerate(rows) for j, t in enumerate(r)], "node long, norm string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1, 2 * i, 2 * i + 1) for i in range(len(rows))], "a long, b long, la long, lb long")
    got = {r["a"] // 2 for r in line_dedup._verified(pairs, texts, 0.8)[0].collect()}
    want = {i for i, r in enumerate(rows) if near(*r)}
    assert got == want and 0.2 * len(rows) < len(want) < 0.8 * len(rows)


def test_line_dedup_reads_documents_once_to_find_lines(spark):
    """Lines are cut and normalised once, not again for those that share blocks."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [(i, f"alpha beta gamma delta epsilon {i % 7}\nthis line stands in many documents or nearly {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", counted.asNondeterministic()("text").alias("text"))
    assert line_dedup.line_groups(docs, "doc_id", "text").count() > 30
    assert read.value == len(rows)


def test_line_dedup_words_of_unlike_length(spark):
    """Long words written for short ones in half of the places and short for long in the others cost more than the longest words of either line."""
    rng = np.random.default_rng(31)
    x = ["".join(rng.choice(list("abcdefghiklmnop"), 6)) for _ in range(174)]
    y = list(x)
    for i in range(24):
        a, b = ("z" * 12, "qq") if i % 2 else ("vv", "w" * 12)
        x[7 * i + 3], y[7 * i + 3] = a, b
    x, y = " ".join(x), " ".join(y)
    most = int(0.2 * max(len(x), len(y)) + 1e-9)
    assert len(x) > 1000 and most < edit_distance(x, y) < 1.3 * most
    texts = spark.createDataFrame([(0, x), (1, y)], "node long, norm string")
    pairs = spark.createDataFrame([(0, 1, 0, 1)], "a long, b long, la long, lb long")
    assert line_dedup._verified(pairs, texts, 0.8)[0].count() == 0
