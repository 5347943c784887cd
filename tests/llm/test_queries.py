"""The registered queries themselves, on small tables in a folder, against plain Python."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from plansmith.llm.queries import QUERIES
from plansmith.llm.tokens import vocabulary_path

from .data import documents, frame
from .test_duplicates import brute_groups
from .test_rules_and_scans import plain_rules


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = list({r[0]: r for r in documents() if r[0] is not None}.values())
    frame(spark, rows).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(8, 1, 0), (12, 1, 0), (13, 1, 1), (14, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), {r[0]: r[1] for r in rows}


@pytest.fixture(scope="module")
def ids(folder):
    library = Tokenizer.from_file(vocabulary_path())
    return {i: library.encode(t or "", add_special_tokens=False).ids for i, t in folder[1].items()}


def crc(values):
    return zlib.crc32(np.array(values, dtype="<u4").tobytes())


def test_op1(spark, folder, ids):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op1_rans"](spark, folder[0]).collect()}
    at, want = 0, {}
    for i in sorted(ids):
        own = [*ids[i], 1]
        want[i] = (at, len(own), crc(own))
        at += len(own)
    assert got == want


def test_op3(spark, folder, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op3_packing"](spark, folder[0]).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for i, some in pieces.items():
        own, at = [*ids[i], 2], 0
        for start, length, digest, total in sorted(some):
            assert start == at and total == len(own) and digest == crc(own[start : start + length])
            at += length
        assert at == len(own)
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    assert len(sequences) <= 1 + sum(map(len, ids.values())) // 4096 + 4  # one window for each of the tasks


def test_op4(spark, folder):
    rows = QUERIES["op4_sharding"](spark, folder[0]).collect()
    raw = {i: (t or "").encode() for i, t in folder[1].items()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {i: (len(x) + 8, zlib.crc32(x), "rows", None) for i, x in raw.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(24))
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_op7(spark, folder):
    for r in QUERIES["op7_fertility"](spark, folder[0]).collect():
        want = plain_rules(folder[1][r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want[:6]
        assert not (r["kept"] and r["base_failed"])


def test_other_queries(spark, folder):
    path, texts = folder
    assert {r["doc_id"] for r in QUERIES["op2_line_dedup"](spark, path).collect()} == texts.keys()
    scored = {r["doc_id"]: r for r in QUERIES["op5_cross_entropy"](spark, path).collect()}
    assert scored.keys() == texts.keys() and {i for i, r in scored.items() if r["is_target"]} == {8, 12}
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op10_jaccard"](spark, path).collect()) == brute_groups(list(texts.items()))
    found = {r["doc_id"]: r for r in QUERIES["op9_license_scan"](spark, path).collect()}
    assert found.keys() == texts.keys() and all((r["n_matches"] == 0) == (r["licenses"] == "") for r in found.values())


def test_op6(spark, folder, ids):
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op6_trie_bpe"](spark, folder[0]).collect()}
    assert got == {i: len(x) for i, x in ids.items()} and Counter(got.values())
