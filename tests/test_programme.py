"""Facts of programmes from phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from plansmith.functions import programme as pr


def values(spark, f, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r["v"] for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_durations(spark):
    assert values(spark, pr.duration_years, ["2 года", "3 года обучения", "1 год", "несколько лет", "2-3 года", "на три года", None, "0 лет"]) == [2, 3, 1, None, None, None, None, None]


def test_ages(spark):
    got = values(spark, pr.age_range, ["11-12 лет", "8 – 11 лет", "от 10 до 14 лет", "11 лет", "2011-2012", "14-8 лет", None])
    assert [None if v is None else tuple(v) for v in got] == [(11, 12), (8, 11), (10, 14), None, None, None, None]


def test_study_years(spark):
    assert values(spark, pr.study_year_label, [None, "второй", "программа 1 г.docx", "специальный набор", "  "]) == [None, "2 год обучения", "1 год обучения", "специальный набор год обучения", None]


def test_academic_years(spark):
    cases = ["План на 2026-2027 учебный год\n2026/27 учебного года", "срок реализации 2001–2005", "учебный год 2026–2027 и 2027–2028", ""]
    assert values(spark, pr.academic_year_mentions, cases) == [["2026–2027"], [], ["2026–2027", "2027–2028"], []]
    pairs = [(["2026–2027"], ["2026–2027"]), (["2026–2027"], []), (["2026–2027"], ["2027–2028"]), ([], [])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [tuple(r["v"]) for r in df.select("i", pr.resolve_academic_year(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == [("auto", "2026–2027"), ("single", "2026–2027"), ("conflict", None), ("missing", None)]


def test_lists(spark):
    assert values(spark, pr.attestation_statements, ["Текст\n Итоговая  аттестация \nитог", None]) == [["Итоговая аттестация"], None]
    assert values(spark, pr.outcome_items, ["- знает правила;\n• умеет ходить.; ;знает правила"]) == [["знает правила", "умеет ходить"]]
