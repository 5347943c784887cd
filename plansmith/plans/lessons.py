"""Lesson forms and controls from the text of activities, as ordered rules over clauses.

A clause's first rule in ``FIRST_RULES`` gives its form two points; the weaker rules are tried only where none of those fits and each gives one. A
form leads if it has two points or more and more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rollups

#: Patterns of a lower-case clause and the form that they mean, in order of precedence.
FIRST_RULES = [
    (r"^(?:(?:дидактическ|ролев|подвижн)\w*\s+)?игр[аы]\b", "игра"),
    (r"^экскурси(?:я|и|ю|ей|онн\w*)\b", "экскурсия"),
    (r"^прогул\w*\s+и\s+экскурси|экскурси.*(?:прогул|посещен)|(?:прогул|посещен).*экскурси", "экскурсия"),
    (r"^(?:мероприятие|праздник)", "практическое занятие"),
    (r"практикум", "практикум"),
    (r"\b(?:тестирован|диагностик)", "тестирование"),
    (r"\bтренинг", "тренинг"),
    (r"творческая работа|^(?:аппликаци|конструирован|рисован)", "творческая работа"),
    (r"^наблюден", "занятие-наблюдение"),
    (r"^соревнован|участи\w*\s+в\b.{0,40}соревнован", "соревнования"),
    (r"^поход|участи\w*\s+в\s+поход", "поход"),
    (r"^прогул", "прогулка"),
    (r"ситуационн", "ситуационное занятие"),
    (r"^(?:отработка|упражнен)", "тренировочное занятие"),
    (r"тренировочн(?:ое|ые|ая)\s+занят|^тренировк[аи]", "тренировочное занятие"),
    (r"исследован|изучение района", "исследовательское занятие"),
    (r"на местности|на маршруте", "занятие на местности"),
]
WEAKER_RULES = [(r"экскурси", "экскурсия"), (r"\bигр[аы]\b|игровые", "игра"), (r"мероприяти|праздник", "практическое занятие"), (r"^отработк", "тренировочное занятие"), (r"в походе", "занятие на местности"), (r"проект", "проектное занятие"), (r"бесед", "беседа")]
#: Patterns of an activity (or, where marked, of the form) and the control that they mean, in order of precedence.
CONTROL_RULES = [
    ("form", r"экскурси|игр|на местности", "наблюдение"),
    ("text", r"доклад|отч[её]т|заслушиван", "защита результата"),
    ("text", r"викторин", "викторина"),
    ("text", r"ситуационн", "ситуационная задача"),
    ("text", r"\bтест", "тестирование"),
    ("text", r"аппликац|рисунк|творческ|конструир|мероприяти|праздник", "творческая работа"),
    ("text", r"меню|продукт.*(?:составлен|спис|расч[её]т)|(?:составлен|спис|расч[её]т).*продукт", "проверка меню"),
    ("text", r"карт|компас|абрис|азимут|масштаб|топограф|транспортир|курвиметр", "работа с картой"),
    ("text", r"отработк|упражнен|техник|при[её]м|тренировк", "демонстрация навыка"),
    ("form", r"теоретическ|бесед", "устный опрос"),
    ("form", r"практикум|проектн|исследовател", "практическое задание"),
    ("form", r"трениров", "демонстрация навыка"),
    ("form", r"практическ", "практическое задание"),
]
THEORY, PRACTICE = "теоретическое занятие", "практическое занятие"


def _is(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(f"(?iuUs){pattern}"))


def clause_points(clause: Column) -> Column:
    """The forms that a clause gives points to: an array of (form, points)."""
    c = F.lower(clause)
    first = F.lit(None).cast("string")
    for pattern, form in reversed(FIRST_RULES):
        first = F.when(_is(c, pattern), form).otherwise(first)
    strong = F.array(F.struct(first.alias("form"), F.lit(2).alias("points")))
    weak = F.array_compact(F.array(*[F.when(_is(c, p), F.struct(F.lit(form).alias("form"), F.lit(1).alias("points"))) for p, form in WEAKER_RULES]))
    return F.when(first.isNotNull(), strong).otherwise(weak)


def form_scores(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Points of each form in each row's text: keys, form, points."""
    clauses = rows.select(*keys, F.explode(tx.clause_units(F.col(text))).alias("clause"))
    return clauses.select(*keys, F.inline(clause_points(F.col("clause")))).groupBy(*keys, "form").agg(F.sum("points").alias("points"))


def dominant_forms(rows: DataFrame, keys: list[str], text: str, least: int = 2) -> DataFrame:
    """The leading form of each row's text, if one leads: keys, label, top_score."""
    return rollups.dominant_label(form_scores(rows, keys, text), keys, "form", "points", least)


def lesson_type(practice_form: Column, theory_hours: Column, practice_hours: Column, has_practice_text: Column) -> Column:
    """The form of a lesson by its hours: theory alone, practice alone, or by the leading form and the larger part."""
    return F.when(practice_hours == 0, F.when(practice_form == "беседа", "беседа").otherwise(THEORY)).when(practice_form.isNotNull() & (practice_form != "беседа"), practice_form).when(theory_hours == 0, PRACTICE).when(has_practice_text | (practice_hours >= theory_hours), PRACTICE).otherwise(THEORY)


def control_for(form: Column, activity: Column, theory_hours: Column, practice_hours: Column) -> Column:
    """How a lesson is assessed: the first rule that fits its form or activity, else by its hours."""
    out = F.when((theory_hours > 0) & (practice_hours == 0), "устный опрос").when(practice_hours > 0, "практическое задание").otherwise("устный опрос")
    sources = {"form": F.lower(F.coalesce(form, F.lit(""))), "text": F.lower(F.coalesce(activity, F.lit("")))}
    for source, pattern, control in reversed(CONTROL_RULES):
        out = F.when(_is(sources[source], pattern), control).otherwise(out)
    return out


def derive_lessons(parts: DataFrame) -> DataFrame:
    """Form and control of every week part (doc_id, week, part_pos and its hours and content, as week_parts gives them).

    The content's text after its practice marker is the practice; without a marker a part with practice hours alone is all practice.
    """
    keys = ["doc_id", "week", "part_pos"]
    marked, rest = tx.split_at_marker(F.concat(F.lit("\n"), F.col("program_content")), "\nПрактика.")
    practice = F.when(rest.isNotNull(), rest).when((F.col("theory_hours") == 0) & (F.col("practice_hours") > 0), F.col("program_content")).otherwise("")
    rows = parts.withColumns({"theory_text": F.trim(F.regexp_replace(F.when(practice == F.col("program_content"), F.lit("")).otherwise(marked), r"^\n", "")), "practice_text": practice})
    forms = dominant_forms(rows.where("practice_text != ''"), keys, "practice_text").select(*keys, F.col("label").alias("practice_form"))
    j = rows.join(forms, keys, "left")
    kind = lesson_type(F.col("practice_form"), F.col("theory_hours"), F.col("practice_hours"), F.col("practice_text") != "")
    return j.withColumn("lesson_type", kind).withColumn("assessment_method", control_for(F.col("lesson_type"), F.col("practice_text"), F.col("theory_hours"), F.col("practice_hours"))).drop("practice_form")
