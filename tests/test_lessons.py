"""Forms and controls of lessons."""

from __future__ import annotations

from pyspark.sql import functions as F

from plansmith.plans.lessons import control_for, derive_lessons, dominant_forms, form_scores


def test_forms(spark):
    rows = spark.createDataFrame([(1, "Ролевая игра «Поход». Беседа о правилах."), (2, "Отработка узлов; упражнения в парах. Экскурсия в музей."), (3, "Беседа. Рассказ."), (4, "Экскурсия. Игра."), (5, ""), (6, "Участие в районных соревнованиях")], "k int, t string")
    scores = {(r["k"], r["form"]): r["points"] for r in form_scores(rows, ["k"], "t").collect()}
    assert scores == {(1, "игра"): 2, (1, "беседа"): 1, (2, "тренировочное занятие"): 4, (2, "экскурсия"): 2, (3, "беседа"): 1, (4, "экскурсия"): 2, (4, "игра"): 2, (6, "соревнования"): 2}
    lead = {r["k"]: r["label"] for r in dominant_forms(rows, ["k"], "t").collect()}
    assert lead == {1: "игра", 2: "тренировочное занятие", 3: None, 4: None, 6: "соревнования"}


def test_control(spark):
    cases = [("игра", "викторина", 0, 2, "наблюдение"), ("практикум", "Составление меню", 0, 2, "проверка меню"), ("практическое занятие", "Работа с компасом", 1, 1, "работа с картой"), ("теоретическое занятие", "", 2, 0, "устный опрос"), (None, None, 0, 2, "практическое задание"), (None, None, 0, 0, "устный опрос")]
    rows = spark.createDataFrame(cases, "form string, t string, th int, pr int, want string").select("want", control_for(F.col("form"), F.col("t"), F.col("th"), F.col("pr")).alias("got")).collect()
    assert [r["got"] for r in rows] == [c[4] for c in cases]


def test_lessons(spark):
    rows = [("a", 1, 1, 1, 1, "Правила.\nПрактика. Отработка узлов. Упражнения."), ("a", 2, 1, 2, 0, "Рассказ о природе."), ("a", 3, 1, 0, 2, "Экскурсия в лес."), ("a", 4, 1, 0, 2, "")]
    df = spark.createDataFrame(rows, "doc_id string, week int, part_pos int, theory_hours int, practice_hours int, program_content string")
    got = {r["week"]: (r["theory_text"], r["practice_text"], r["lesson_type"], r["assessment_method"]) for r in derive_lessons(df).collect()}
    assert got[1] == ("Правила.", "Отработка узлов. Упражнения.", "тренировочное занятие", "демонстрация навыка")
    assert got[2][2:] == ("теоретическое занятие", "устный опрос")
    assert got[3] == ("", "Экскурсия в лес.", "экскурсия", "наблюдение")
    assert got[4][2:] == ("практическое занятие", "практическое задание")
