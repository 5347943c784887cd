"""Token counts, source divergence and token alignment against the libraries and plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from plansmith.llm import token_counts
from plansmith.llm.divergence import best_terms, divergence, shares, source_divergence
from plansmith.llm.queries import QUERIES, SQL
from plansmith.llm.token_alignment import Aligner, align_tokens, byte_level, components, union_find
from plansmith.llm.token_counts import Counting, count_tokens, cut_down, slices_of
from plansmith.llm.tokens import vocabulary_path

from .data import SCHEMA, documents, frame
from .test_tokens import odd_texts

BYTES, PIECES = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
ODD = ["<|endoftext|>a<|endoftext|><|endoftext|> b", "x\r\n\r\n  y;\r z\r", " \n  lead", "tail  ", "\x1c\x1d a.\x1cb", "a\x85 b　 c", "don't 'sabc 'S we'll", "Ünï ½²³ ªº ǅ ʼ", "a" * 3000, "\t\ta b"]


def rows():
    """The shared documents and odd ones, with ids of their own."""
    out = list(documents())
    texts = ODD + odd_texts()
    return out + [(1000 + i, t, "en", "odd", None, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("counts")
    frame(spark, rows()).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_white_space_and_letters_are_the_librarys():
    """Over all code points: next to letters, numbers, marks and white space, the library makes as many tokens."""
    library, counting = Tokenizer.from_file(BYTES), Counting(BYTES, (b"", b"", b""), max_cached=2000)
    for a in range(0, 0x3200, 64):
        texts = ["".join(f"a{c}1{c}.  {c} \n{c}{c}\r{c} x" for c in map(chr, range(a, a + 64)))]
        texts += [f".{chr(a)}. {chr(a)}", chr(a) * 3]
        assert counting.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts], hex(a)


def test_op11(spark, folder):
    library = Tokenizer.from_file(BYTES)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in rows())
    got = QUERIES["op11_token_counts"](spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(tuple(r) for r in got.collect()) == want and any(x[3] for x in want)


def test_count_tokens_edges(spark, monkeypatch):
    library = Tokenizer.from_file(BYTES)
    for frequent in (1, 50):  # a table of one entry, and one that holds what is common
        got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(frame(spark).where("doc_id IS NOT NULL"), frequent=frequent).collect()}
        assert got == {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in documents() if r[0] is not None}
    assert count_tokens(frame(spark, [])).count() == 0
    clash = frame(spark).withColumn("n_bytes", F.lit("x")).withColumn("id", F.lit(1))
    assert count_tokens(clash).count() == len(documents())
    with pytest.raises(ValueError):
        count_tokens(clash, id_col="n_bytes")
    long = "word \n  other;\r\n" * 3000
    monkeypatch.setattr(token_counts, "_SLICE", 1000)
    assert "".join(slices_of(long)) == long and len(list(slices_of(long))) > 20
    assert Counting(BYTES, (b"", b"", b""), max_cached=3).count([long, None, ""]) == [len(library.encode(long, add_special_tokens=False).ids), 0, 0]
    with pytest.raises(ValueError):
        Counting(vocabulary_path("word_bpe_49k.json"), (b"", b"", b""))


def test_summaries_keep_what_is_frequent():
    counts = Counter({f"w{i}": 1 for i in range(500)})
    counts.update({"hot": 400, "warm": 90})
    cut_down(counts, 10)
    assert len(counts) <= 10 and counts["hot"] > counts["warm"] > 0


def plain_divergence(docs, min_docs=3, top=200):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    own, docs_of, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in docs:
        found = terms.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        lang, source = lang or "", source or ""
        own[lang, source].update(found)
        whole[lang].update(found)
        docs_of[lang].update(set(found))
    out = set()
    for lang in {k[0] for k in own}:
        kept = [t for t, n in docs_of[lang].items() if n >= min_docs]

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: share(c) for (x, s), c in own.items() if x == lang}
        q = share(whole[lang])
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            mine = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, some, last in (("pair", pairs, len(pairs)), ("term", mine, top)):
                for rank, (item, value) in enumerate(sorted(some, key=lambda x: (-x[1], x[0].encode()))[:last], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def divergent_rows():
    out = [(i, t, ["en", None, "de"][i % 3], [None, "a", "b", "ü"][i % 4], None, None) for i, t in enumerate(["Ü ß A a B", "a a a b-c d_e", "É é É 日本 日本語 a1b2", "the THE The ende"] * 9)]
    out += [(100 + i, "alone " * (i + 1), "fr", "only", None, None) for i in range(3)] + [(200 + i, t, "xx", f"s{i % 2}", None, None) for i, t in enumerate([None, "", "rare"])]
    return out + rows()


def test_op12(spark, tmp_path):
    frame(spark, divergent_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_divergence(divergent_rows())
    got = QUERIES["op12_divergence"](spark, str(tmp_path))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert any(r[0] == "xx" and r[2] == "pair" and r[4] == 0 for r in want)
    tiny = source_divergence(frame(spark, divergent_rows()), top_terms=3, min_docs=2, tile_cells=16)  # many tiles of few terms
    assert Counter(tuple(r) for r in tiny.collect()) == Counter(plain_divergence(divergent_rows(), 2, 3))
    assert source_divergence(frame(spark, [])).count() == 0
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(con.execute(SQL["op12_divergence"]).fetchall()) == Counter(want)


def test_shares_are_exact():
    for n, total, kept in ((0, 0, 1), (10**13, 10**13 + 7, 10**9), (5, 9_000_000_000_000_000 - 10, 3), (2, 2, 1)):
        assert int(shares(np.array([n]), total, kept)[0]) == 1 + 10**9 * (n + 1) // (total + kept)
    assert divergence(np.array([10**9]), np.array([1])).tolist() == [(10**9 - 1) ** 2]
    assert best_terms(np.array([5, -1, 7, 5, 0]), 2).tolist() == [2, 0]


def plain_alignment(texts):
    """Ids of both sides and cut points of each text, the counts of pairs that end together, and the rows that follow."""
    a_lib, b_lib, chars = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_level()
    a_lib.encode_special_tokens = True
    names = {i: t for t, i in a_lib.get_vocab().items()}
    cut, links = [], Counter()
    for text in texts:
        cut.append(None)
        if not text:
            continue
        a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
        pieces = [b_lib.id_to_piece(i) for i in b]
        a_raw = [bytes(chars[c] for c in names[i]) for i in a]
        b_raw = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
            continue
        a_end, b_end = (np.cumsum([len(x) for x in raw]).tolist() for raw in (a_raw, b_raw))
        cut[-1] = (a, b, a_end, b_end)
        both = set(a_end) & set(b_end)
        links.update((i, j) for i, j in zip((i for i, e in zip(a, a_end, strict=True) if e in both), (j for j, e in zip(b, b_end, strict=True) if e in both), strict=True))
    most = defaultdict(int)
    for (_, j), n in links.items():
        most[j] = max(most[j], n)
    out = []
    for x in cut:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, a_end, b_end = x
        groups, at = [], [0, 0]
        for e in sorted(set(a_end) & set(b_end)):
            p, q = a_end.index(e) + 1, b_end.index(e) + 1
            groups.append((a[at[0] : p], b[at[1] : q]))
            at = [p, q]
        pairs = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(pairs), sum(links[p] == most[p[1]] for p in pairs), sum(links[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_op13(spark, folder):
    own = rows()
    want = Counter((r[0], *x) for r, x in zip(own, plain_alignment([r[1] for r in own]), strict=True))
    got = QUERIES["op13_alignment"](spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want
    many = align_tokens(frame(spark, own), batch_bytes=2000).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    assert Counter(tuple(r) for r in many.collect()) == want  # batches of few texts


def test_align_edges(spark):
    assert align_tokens(frame(spark, [])).count() == 0
    assert [tuple(r)[1:] for r in align_tokens(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    with pytest.raises(ValueError):
        align_tokens(frame(spark), links="all")
    with pytest.raises(ValueError):
        align_tokens(frame(spark).withColumn("n_a", F.lit(1)), id_col="n_a")
    assert align_tokens(frame(spark).withColumn("groups", F.lit("x")).withColumn("pair", F.lit(1))).count() == len(documents())


def test_overlapping_links(spark):
    """All overlapping pairs, counted over the corpus, from plain ranges."""
    texts = ["Unbelievably antidisestablishmentarian wörds", "wörds wörds 12345 hyperparameterization", "日本語 テスト"]
    aligner = Aligner(BYTES, PIECES, "overlap")
    links, rows_of = Counter(), []
    for t in texts:
        a, b = aligner.a.tok.encode(" " + t, add_special_tokens=False).ids, aligner.b.encode(t)
        a_end, b_end = np.cumsum(aligner.a_size[a]), np.cumsum(aligner.b_size[b])
        pairs = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(a_end[i - 1] if i else 0, b_end[j - 1] if j else 0) < min(a_end[i], b_end[j])]
        links.update(pairs)
        rows_of.append(pairs)
    got = align_tokens(frame(spark, [(i, t, None, None, None, None) for i, t in enumerate(texts)]), links="overlap").collect()
    assert {r["doc_id"]: (r["n_links"], r["count_sum"]) for r in got} == {i: (len(p), sum(links[x] for x in p)) for i, p in enumerate(rows_of)}
    assert any(len(p) > len(set(p)) or r["n_links"] > r["n_groups"] for p, r in zip(rows_of, got, strict=True))


def test_components():
    def groups(a, b):
        x, y, *_ = components(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        return x.tolist(), y.tolist()

    assert groups([1, 3, 5], [2, 3, 5]) == ([0, 0, 1], [0, 0, 1])
    assert groups([4], [1, 2, 4]) == ([0], [0, 0, 0])
    assert groups([], []) == ([], [])
    rng = np.random.default_rng(2)
    for _ in range(50):  # groups are what lies between the ends that both sides have
        a, b = (sorted({*rng.integers(1, 60, 20).tolist(), 60}) for _ in range(2))
        both = sorted(set(a) & set(b))
        assert groups(a, b) == tuple([np.searchsorted(both, e) for e in x] for x in (a, b))
    edges = rng.integers(0, 200, (150, 2))
    up = list(range(200))
    for _ in range(200):
        for u, v in edges.tolist():
            up[u] = up[v] = min(up[u], up[v])
    assert union_find(200, edges[:, 0], edges[:, 1]).tolist() == up


def test_words_with_the_sign_between_words():
    aligner = Aligner(BYTES, PIECES, "end")
    words = [" a", " b\x01c", "\n\x01", " ", " dé", "  \x01", " 日本"]
    whole = aligner.align(words)
    for k, w in enumerate(words):
        one = aligner.align([w])
        assert (one.groups[0], one.n_a[0], one.n_b[0], one.n_groups[0], one.n_links[0]) == (whole.groups[k], whole.n_a[k], whole.n_b[k], whole.n_groups[k], whole.n_links[k])
    assert whole.good.all() and aligner.align([]).groups == []


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if re.match(r"op\d+_", k)}
    assert SCHEMA.startswith("doc_id")
