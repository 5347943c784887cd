"""Small documents with the awkward cases: nulls, empty and long texts, copies, near copies, repeated rows and clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()) + rng.choice(["", "a", "us", "ing", ",", "."]) for _ in range(n)]


def documents(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", "   \n\t ", "one", "two words", "a b c d", "Hello, WORLD! it's <|endoftext|> ünï ﬁ 日本 12", "x" * 3000]
    base = words(rng, 120)
    texts += [" ".join(base), " ".join(base), " ".join(base).upper()]
    for k in (1, 2, 3, 10, 40):
        near = list(base)
        for i in rng.sample(range(120), k):
            near[i] = f"new{i}"
        texts.append(" ".join(near))
    for _ in range(12):
        lines = [" ".join(words(rng, rng.randint(3, 30))) for _ in range(rng.randint(1, 6))]
        lines.insert(rng.randint(0, len(lines)), "This line stands in many documents, word for word or nearly.")
        texts.append("\n".join(lines))
    texts.append("\n".join(["This line stands in many documents word for word or nearly!", "Again and again.", "", "Again and again.", "***"]))
    texts.append(" ".join(words(rng, 20_000)))
    rows = [(i, t, ["en", None, "xx"][i % 3], f"src{i % 2}", None, "e") for i, t in enumerate(texts)]
    rows.append(rows[8])  # a repeated row
    rows.append((None, "a row without id " * 12, "en", None, 3, None))
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
