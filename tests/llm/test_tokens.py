"""Token operators against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plansmith.llm.packing import pack_documents, pack_window, piece_cost
from plansmith.llm.token_files import Rans, quantise, read_token_files, write_token_files
from plansmith.llm.tokens import encoder, vocabulary_path
from plansmith.llm.trie_bpe import TrieBpe, encode_documents

from .data import SCHEMA, documents, frame


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(3)
    made = [" ".join("".join(rng.choice("aehinrst'.,!-0ßé") for _ in range(rng.randint(1, 14))) for _ in range(400)) for _ in range(5)]
    return ["á é Ω İstanbul ΣΑΣ x y 　z \x1c w", "<|startoftext|>x's't", "日本語 テスト 한국어 🎉🎉 don't I'LL hahahahaha ......!!!", "ﬁ ª º µ × ÷ ß ẞ Ǆ", "́abc ́", "a\x85b", "ab" * 5000, *made]


def test_encoders_equal_the_library(library):
    texts = [r[1] for r in documents()] + odd_texts()
    want = [np.array(ids_of(library, t), dtype="<u4").tobytes() for t in texts]
    assert list(encoder(vocabulary_path()).encode(texts)) == want
    trie = TrieBpe(vocabulary_path())
    assert list(trie.encode_all(texts)) == want
    assert [trie.encode(t) for t in texts] == want
    for ids in want:
        assert trie.decode(ids).decode() == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_trie_bpe_rows(spark, library):
    got = encode_documents(frame(spark), digest_only=True).collect()
    rows = documents()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), len(i := ids_of(library, r[1])), hashlib.sha256(np.array(i, dtype="<u4").tobytes()).hexdigest()) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"]) for r in got) == want
    full = encode_documents(frame(spark).where("doc_id = 6")).first()
    assert full["decoded"] == library.decode(np.frombuffer(full["ids"], "<u4").tolist(), skip_special_tokens=False)
    assert encode_documents(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        encode_documents(frame(spark).withColumnRenamed("extra", "n_tokens"))


def test_rans_round_trip():
    rng = np.random.default_rng(0)
    p = 1 / np.arange(1, 2001)
    for sizes in ([], [0], [1], [5, 0, 8192, 8193, 40_000]):
        chunks = [rng.choice(2000, size=n, p=p / p.sum()).astype(np.uint16) for n in sizes]
        counts = sum((np.bincount(c, minlength=3000) for c in chunks), np.zeros(3000, dtype=np.int64))
        freq = quantise(counts)
        assert freq.sum() in (0, 1 << 20) and ((freq > 0) == (counts > 0)).all()
        data = Rans(freq).encode(chunks)
        assert all((a == b).all() for a, b in zip(Rans(freq).decode(data), chunks, strict=True))
    broken = bytearray(data[-1])
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        Rans(freq).decode([bytes(broken)])
    # many rare tokens beside one frequent one
    counts = np.concatenate([[10**9], np.ones(900_000, dtype=np.int64)])
    assert quantise(counts).sum() == 1 << 20 and quantise(counts).min() == 1


def test_token_files(spark, library):
    path = write_token_files(frame(spark))
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in read_token_files(spark, path).collect()), key=lambda r: r[2])
    rows = sorted(((r[0] is not None, r[0] or 0, ids_of(library, r[1]) + [1]) for r in documents()), key=lambda r: r[:2])
    at, want = 0, []
    for has, i, ids in rows:
        want.append((has, i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert read_token_files(spark, write_token_files(frame(spark, []))).count() == 0


def test_packing(spark, library):
    out = pack_documents(frame(spark), capacity=512, window_tokens=20_000).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r["piece_ids"]) == 4 * r["piece_length"] > 0
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["seq_offset"]):
            assert r["seq_offset"] == at
            at += r["piece_length"]
        assert at <= 512
    for i, text, *_ in documents():
        ids = ids_of(library, text) + [2]
        copies = sum(r[0] == i for r in documents())
        pieces = sorted(by_doc[i], key=lambda r: r["piece_start"])
        assert sum(r["piece_length"] for r in pieces) == copies * len(ids)
        for r in pieces:
            assert np.frombuffer(r["piece_ids"], "<u4").tolist() == ids[r["piece_start"] : r["piece_start"] + r["piece_length"]]
            assert r["doc_tokens"] == len(ids) and r["extra"] in ("e", None)
    assert pack_documents(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        pack_documents(frame(spark).withColumnRenamed("extra", "sequence_id"))


def test_pack_window():
    rng = random.Random(5)
    for _ in range(40):
        lengths = [rng.choice([0, 1, rng.randint(1, 400), rng.randint(1, 50)]) for _ in range(rng.randint(0, 80))]
        pieces, n = pack_window(lengths, capacity=100)
        covered = defaultdict(list)
        used = [0] * n
        for d, at, size, s, offset in pieces:
            assert offset == used[s] and size > 0
            used[s] += size
            covered[d] += range(at, at + size)
        assert all(u <= 100 for u in used) and 100 * n - sum(lengths) < 100
        assert all(sorted(covered[d]) == list(range(k)) for d, k in enumerate(lengths))
    # the lowest-cost sequence is taken: two long documents apart, short ones balance
    pieces, _ = pack_window([60, 50, 30, 20, 20], capacity=100, linear=1, quadratic=1)
    cost = defaultdict(float)
    for _, _, size, s, _ in pieces:
        cost[s] += piece_cost(size, 1, 1)
    assert max(cost.values()) <= 60 + 3600 + 30 + 900


def test_schema_is_that_of_documents():
    assert SCHEMA.startswith("doc_id long, text string, lang string, source string, n_chars long")


def test_ids_of_any_name(spark):
    """Columns of the caller that are named like inner ones."""
    from plansmith.llm.jaccard_join import jaccard_groups
    from plansmith.llm.lm_scoring import cross_entropy_difference
    from plansmith.llm.sharding import shard_rows
    from plansmith.llm.vector_files import exact_top_k

    docs = spark.createDataFrame([(1, "a b c d e f g", 5), (2, "a b c d e f g", 6)], "tokens long, text string, _place int")
    assert [(r[0], r["n_tokens"]) for r in sorted(read_token_files(spark, write_token_files(docs, id_col="tokens")).select("doc_id", "n_tokens").collect())] == [(1, 8), (2, 8)]
    for name in ("n", "cls", "first", "bits", "_id"):
        assert sorted(tuple(r) for r in jaccard_groups(docs.select(docs.tokens.alias(name), "text"), id_col=name).collect()) == [(1, 3, 1), (2, 3, 1)]
    with pytest.raises(ValueError):
        jaccard_groups(docs.withColumnRenamed("tokens", "n_shingles"), id_col="n_shingles")
    with pytest.raises(ValueError):
        cross_entropy_difference(docs.withColumnRenamed("tokens", "score"), docs.select(docs.tokens.alias("score")), id_col="score")
    inner = docs.toDF("_part", "_at", "_first")
    assert shard_rows(inner, ["_part"]).select("_part", "_at", "_first").count() == 2
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "dim long, embedding array<float>")
    assert exact_top_k(vectors, F.col("dim") == 0, k=1, id_col="dim").select("query_id", "id").first()[:] == (0, 1)
