"""Normative checks of plans: independent conditions with three verdicts, one row per plan and check."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import week_grid
from ..session import tasks_for
from .planning import in_force, verdict
from .schedule import by_plan, compared, gathered

#: Stems that mark a lesson form as practical or as theoretical, and the winter break of the approved grid.
PRACTICE_STEMS, THEORY_STEMS = ["практи", "тренировоч", "игра", "экскурси", "поход"], ["теорет", "лекци", "беседа"]
VACATION = ("2026-12-31", "2027-01-10")


def _present(x: Column) -> Column:
    return F.length(F.trim(F.coalesce(x, F.lit("")))) > 0


def _any_stem(x: Column, stems: list[str]) -> Column:
    out = F.lit(False)
    for s in stems:
        out = out | F.contains(F.lower(x), F.lit(s))
    return out


def _spread(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per check; a condition that is null was not checked."""
    structs = [F.struct(F.lit(n).alias("check_id"), verdict(c).alias("verdict")) for n, c in checks.items()]
    return rows.select("doc_id", F.inline(F.array(*structs)))


def registry_checks(plans: DataFrame, periods: list[tuple[date | None, date | None]]) -> DataFrame:
    """Whether every regulation, given by its period in force, covers some of the plan's academic year; open ends cover all."""
    ok = F.lit(True)
    for begin, end in periods:
        ok = ok & in_force(F.lit(begin).cast("date"), F.lit(end).cast("date"), F.col("start_year"))
    return _spread(plans, {"registry_in_force": ok if periods else F.lit(None).cast("boolean")})


def programme_checks(programmes: DataFrame) -> DataFrame:
    """Facts that a programme must state. Columns: doc_id, student_age, duration_years, study_year_number, expected_results, academic_year, plan_academic_year."""
    year, span = F.col("study_year_number"), F.col("duration_years")
    both = F.col("academic_year").isNotNull() & F.col("plan_academic_year").isNotNull()
    return _spread(programmes, {
        "age_found": _present(F.col("student_age")), "duration_found": span.isNotNull(), "study_year_found": year.isNotNull(), "year_within_duration": year.between(1, span),
        "expected_results": F.coalesce(F.size("expected_results"), F.lit(0)) > 0, "academic_year_match": F.when(both, F.col("academic_year") == F.col("plan_academic_year")),
    })


def workload_checks(facts: DataFrame) -> DataFrame:
    """Stated hours against each other and where the load comes from. Columns of plan_metadata and ``total_hours``, ``provenance``."""
    stated = F.array_distinct(F.array_compact(F.array("hours_per_year", "stated_schedule_hours", "total_hours")))
    return _spread(facts, {"yearly_hours": F.when(F.size(stated) > 0, F.size(stated) == 1), "weekly_load": F.when(F.col("provenance").isNotNull(), ~F.startswith("provenance", F.lit("derived")))})


def hour_checks(positions: DataFrame) -> DataFrame:
    """Arithmetic of topics and of the totals row."""
    h = F.col("hours")
    topic = F.col("kind") == "topic"
    last = F.when(F.col("kind") == "total", F.col("pos"))
    stated = [F.max_by(x, last).alias(n) for x, n in ((h.isNotNull(), "stated"), (h["theory"], "t_theory"), (h["practice"], "t_practice"))]
    sums = by_plan(positions, tasks_for(positions)).groupBy("doc_id").agg(F.bool_and(F.when(topic, h["total"] == h["theory"] + h["practice"])).alias("rows_add_up"), F.sum(F.when(topic, h["theory"])).alias("theory"), F.sum(F.when(topic, h["practice"])).alias("practice"), *stated)
    return _spread(sums, {"topic_hours": F.col("rows_add_up"), "theory_practice_hours": F.when(F.col("stated"), (F.col("theory") == F.col("t_theory")) & (F.col("practice") == F.col("t_practice")))})


def calendar_checks(rows: DataFrame, loads: DataFrame) -> DataFrame:
    """Checks of finished calendars. ``rows``: doc_id, week, start_day, end_day, lesson_type, theory_hours, practice_hours; ``loads``: doc_id, hours_per_week.

    A theory-only row with a practical form, or a practice-only row with a theoretical one, is a conflict; a week must not touch the winter break; a
    week of fewer than seven days should not carry a full load.
    """
    form = F.coalesce("lesson_type", F.lit(""))
    conflict = F.when((F.col("practice_hours") == 0) & (F.col("theory_hours") > 0), _any_stem(form, PRACTICE_STEMS)).when((F.col("theory_hours") == 0) & (F.col("practice_hours") > 0), _any_stem(form, THEORY_STEMS)).otherwise(False)
    a, b = (F.lit(x).cast("date") for x in VACATION)
    touches = (F.col("start_day") <= b) & (F.col("end_day") >= a)
    short = (F.datediff("end_day", "start_day") + 1 < 7) & (F.col("theory_hours") + F.col("practice_hours") >= F.col("hours_per_week"))
    by = rows.join(loads, "doc_id", "left").groupBy("doc_id").agg(F.bool_or(F.when(form != "", conflict)).alias("conflict"), F.bool_or(touches).alias("touches"), F.bool_or(short).alias("short"))
    return _spread(by, {"type_vs_hours": ~F.col("conflict"), "vacation_gap": ~F.col("touches"), "short_week_full_load": ~F.col("short")})


def attestation_check(programmes: DataFrame, traces: DataFrame) -> DataFrame:
    """A programme that states an attestation needs a trace of it in its plan's texts. ``programmes``: doc_id, attestation_statements; ``traces``: doc_id, text."""
    found = traces.groupBy("doc_id").agg(F.bool_or(F.contains(F.lower("text"), F.lit("аттестац"))).alias("found"))
    states = F.coalesce(F.size("attestation_statements"), F.lit(0)) > 0
    return _spread(programmes.join(found, "doc_id", "left"), {"attestation": F.when(states, F.coalesce("found", F.lit(False)))})


def plan_checks(positions: DataFrame, schedule: DataFrame) -> DataFrame:
    """Whether a calendar has the hours of its plan's totals row and exactly its topics.

    ``positions`` as parse_plans gives them, ``schedule`` as build_schedule does. Topics are compared as sets by number, title and section, nulls equal; a topic without parent is its own section.
    Plans without a totals row or without a schedule are not checked. Both tables go through one grouping.
    """
    by = gathered(schedule, positions).groupBy("doc_id").agg(*compared())
    equal = (F.col("theory") == F.col("t_theory")) & (F.col("practice") == F.col("t_practice")) & (F.col("theory") + F.col("practice") == F.col("t_total"))
    return _spread(by, {"plan_matches_utp": F.when(F.col("stated") & F.col("theory").isNotNull(), equal & F.col("same"))})


#: The approved year's first calendar year and number of weeks.
APPROVED_YEAR, APPROVED_WEEKS = 2026, 36


def grid_checks(weeks: DataFrame, plans: DataFrame, approved: int = APPROVED_YEAR) -> DataFrame:
    """Whether a calendar's weeks are those of the approved grid, each once (P20).

    ``weeks``: doc_id, start_day, end_day; ``plans``: doc_id, start_year. Other years warn, plans without weeks are not checked. A plan's weeks are as many as the grid's and have
    all of its bits, so tasks send one row for each of their plans into the grouping, not one for each week.
    """
    grid = week_grid(plans.sparkSession.createDataFrame([(approved,)], "start_year int")).select("start_day", "end_day", F.expr("shiftleft(1L, week - 1)").alias("bit"))
    found = weeks.join(F.broadcast(grid), ["start_day", "end_day"], "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.bit_or("bit").alias("bits"))  # one year's weeks
    whole = (F.col("n") == APPROVED_WEEKS) & (F.col("bits") == (1 << APPROVED_WEEKS) - 1)
    j = plans.join(found.hint("merge"), "doc_id", "left")
    return _spread(j, {"academic_grid": F.when(F.col("n").isNotNull(), F.coalesce((F.col("start_year") == approved) & whole, F.lit(False)))})


def report(*checks: DataFrame) -> DataFrame:
    """All checks as one table."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def summary(report_rows: DataFrame) -> DataFrame:
    """Per plan: how many checks passed, warn and were not made, and the warnings by name in order."""
    v = F.col("verdict")
    return report_rows.groupBy("doc_id").agg(F.count_if(v == "pass").alias("passed"), F.count_if(v == "warning").alias("warnings"), F.count_if(v == "not_checked").alias("not_checked"), F.array_sort(F.collect_set(F.when(v == "warning", F.col("check_id")))).alias("warned"))
