"""Programmes read from paragraphs."""

from __future__ import annotations

from plansmith.functions import text as tx
from plansmith.sources import programme
from pyspark.sql import functions as F

LINES = [
    "Рабочая программа «ЗВЁЗДНЫЙ ПАРУС»", "Срок реализации: 3 года", "Возраст детей: 9–10 лет", "Цель: научить строить модели парусников.", "Задачи: собрать первую модель",
    "• читать чертёж;", "беречь инструмент.", "Формы организации занятий: мастерская.", "Методы обучения: показ и проба.", "Планируемые результаты", "модель держится на воде.",
    "Содержание программы 3-го года обучения", "*1. Корпус", "Шпангоуты из фанеры.", "*2. Паруса", "Крой из ткани.", "*Регата в бассейне", "Пуск моделей и замер времени.", "*4.2 Такелаж",
    "Узлы из нити.", "По окончанию третьего года обучения",
]
OUTCOMES = [
    "По окончанию первого года обучения мастера должны знать: породы дерева; • лаки.", "виды парусов;", "Умения и навыки:", "пилить по линии; 1)", "Учебно-тематический план", "это не исход", "По окончанию второго года обучения мастера должны уметь: клеить", "шлифовать",
    "Планируемые результаты", "Знать:", "устройство рангоута", "1) вопрос теста", "не исход", "Уметь", "сшить парус; породы дерева", "Список литературы", "Знания", "после конца",
]


def paragraphs(spark, **documents):
    rows = [(d, i, t.lstrip("*"), t.startswith("*"), None) for d, lines in documents.items() for i, t in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id string, pos int, text string, is_bold boolean, alignment string")


def test_programme(spark):
    p = paragraphs(spark, a=LINES, b=OUTCOMES)
    got = {r["doc_id"]: r for r in programme.programmes(p).collect()}
    a = got["a"]
    assert (a["title"], a["duration"], a["duration_years"], a["student_age"], a["ages"]["low"], a["ages"]["high"], a["goal"]) == ("ЗВЁЗДНЫЙ ПАРУС", "3 года", 3, "9–10 лет", 9, 10, "научить строить модели парусников.")
    assert a["tasks"] == ["собрать первую модель", "читать чертёж;", "беречь инструмент."] and a["lesson_forms"] == ["мастерская."] and a["teaching_methods"] == ["показ и проба."]
    assert a["expected_results"] == ["модель держится на воде."]
    items = programme.content_items(programme.lines_of(p)).where("doc_id = 'a'").orderBy("pos").collect()
    assert [(r["number"], r["title"], r["parent_section"]) for r in items] == [("1", "Корпус", "Корпус"), ("2", "Паруса", "Паруса"), (None, "Регата в бассейне", "Паруса"), ("4.2", "Такелаж", "Паруса")]
    assert items[0]["content"] == "Шпангоуты из фанеры." and items[3]["content"] == "Узлы из нити."
    b = got["b"]
    assert b["knowledge_outcomes"] == ["породы дерева", "• лаки", "виды парусов", "устройство рангоута"] and b["skill_outcomes"] == ["пилить по линии", "сшить парус", "породы дерева"]
    second = {r["doc_id"]: r for r in programme.programmes(p, study_year=2).collect()}["b"]
    assert second["knowledge_outcomes"] == ["устройство рангоута"] and second["skill_outcomes"] == ["клеить", "шлифовать", "сшить парус", "породы дерева"]


def test_week_controls(spark):
    rows = [["Проверка меню.", "проверка меню", "Проверка карты"], ["устный опрос по теме карты", "Устный опрос по теме карты и компасу", "викторина"], ["викторина", ""], ["по теме „А“", "по теме „А“", "зачёт"], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c array<string>")
    got = [r["m"] for r in df.select("i", tx.merged_controls(F.col("c")).alias("m")).orderBy("i").collect()]
    assert got == ["проверка меню и карты", "Устный опрос по теме карты и компасу; викторина", "викторина", "по теме „А“; зачёт", ""]
