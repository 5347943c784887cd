"""The pipeline's stages against the operators' plain versions."""

from __future__ import annotations

import re

import numpy as np

import corpus_pipeline
from plansmith.llm.line_dedup import dedup_lines
from plansmith.llm.quality_rules import quality_rules
from plansmith.llm.queries import QUERIES, SQL

from .data import documents, frame
from .test_duplicates import brute_groups


def test_stages(spark, tmp_path):
    rows = [(i, t, lang, s, None if t is None else len(t), "e") for i, t, lang, s, *_ in documents()]
    words = [f"word{i}" for i in range(300)]
    near = [" ".join(words[100:200]), " ".join([*words[100:196], "other", *words[197:200]])]
    # near copies in lines that differ too much to be one group of lines, so that the Jaccard stage has to find them
    rows += [(700 + i, "\n".join(f"{w} {i}{k}a {i}{k}b" for k, w in enumerate(words[:40])) + "\n", "en", "s", 1, "e") for i in range(2)]
    rows += [(710 + i, t, "en", "s", 1, "e") for i, t in enumerate(near)] + [(None, near[0], "en", "s", 1, "e"), (None, "x", None, None, None, None)]
    docs = frame(spark, rows).withColumnRenamed("extra", "n_words")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words"]
    before, after = kept["quality rules"]
    good = {r["doc_id"] for r in quality_rules(frame(spark, rows)).where("kept").collect()}
    assert {r["doc_id"] for r in after} == good and 8 in good and 3 not in good
    assert sorted(map(repr, after)) == sorted(repr(r) for r in before if r["doc_id"] in good)
    before, after = kept["line dedup"]
    want = [r for r in dedup_lines(spark.createDataFrame(before, spark.read.parquet(str(tmp_path / "quality rules")).schema)).collect() if re.search(r"\w", r["text"])]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in after))) == sorted(map(repr, ((r["doc_id"], r["text"]) for r in want)))
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    text = {r["doc_id"]: r["text"] for r in after}
    assert text[8] != "" and 9 not in text and sum("stands in many" in t for t in text.values()) == 1
    before, after = kept["n-gram Jaccard join"]
    one_of_each(before, after)
    before, after = kept["packing"]
    tokens = {}
    for r in after:
        tokens.setdefault(r["doc_id"], 0)
        tokens[r["doc_id"]] += r["piece_length"]
        assert len(np.frombuffer(r["piece_ids"], "<u4")) == r["piece_length"]
    assert tokens.keys() == {r["doc_id"] for r in before}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def one_of_each(before, after):
    """Of each brute-force group of rows the one of the smallest id stays."""
    numbered = [(k, r["text"]) for k, r in enumerate(sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"])))]
    ids = sorted((r["doc_id"] for r in before), key=lambda i: (i is None, i))
    first = [ids[k] for k, _, c in brute_groups(numbered) if k == c]
    assert sorted(map(repr, first)) == sorted(repr(r["doc_id"]) for r in after)


def test_near_copies_and_repeated_ids(spark):
    """The Jaccard stage alone, on whole documents: near copies, copies without id, rows that repeat an id with other texts."""
    words = [f"word{i}" for i in range(300)]
    near = [*words[:100]]
    texts = [(1, near), (2, [*near[:50], "new", *near[51:]]), (None, near), (2, words[200:260]), (3, words[200:260]), (3, words[200:260]), (4, []), (None, None), (5, words[150:190])]
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), "e") for i, w in texts], "doc_id long, text string, cls string").repartition(3)
    out = corpus_pipeline.keep_one_of_group(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, len((r["text"] or "").split())) for r in out) == [(0, 0), (1, 100), (2, 60), (4, 0), (5, 40)]
    assert out[0].asDict().keys() == {"doc_id", "text", "cls"}


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(SQL) <= set(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(names)
