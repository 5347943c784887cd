"""What a task or the driver holds does not grow with the tables."""

from __future__ import annotations

import re

from plansmith import session
from plansmith.functions.calendar import week_grid
from plansmith.operators import allocation
from plansmith.plans import audit, remarks, schedule


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_remarks_send_no_keys_through_the_driver(spark):
    rows = [(k, c, v) for k in (1, 2, None) for c, v in (("study_year_found", "pass"), ("duration_found", "warning"), ("year_within_duration", "pass" if k == 2 else "not_checked"), ("topic_hours", "warning"))]
    got = remarks.visible_remarks(spark.createDataFrame(rows, "k int, check_id string, verdict string"), ["k"])
    assert "Broadcast" not in plan_of(got)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "year_within_duration", "not_checked"), (1, "topic_hours", "warning"), (2, "duration_found", "warning"), (2, "topic_hours", "warning"), (None, "year_within_duration", "not_checked"), (None, "topic_hours", "warning")], key=str)


def test_grid_checks_shuffle_plans_not_weeks(spark):
    days = week_grid(spark.createDataFrame([(2026,)], "start_year int")).select("start_day", "end_day").collect()
    weeks = [(1, *d) for d in days] + [(2, *d) for d in [*days[1:], days[1]]] + [(3, None, None)] + [(4, *d) for d in days] + [(5, *d) for d in [*days, days[0]]]
    plans = spark.createDataFrame([(i, 2025 if i == 4 else 2026) for i in range(1, 7)], "doc_id int, start_year int")
    got = audit.grid_checks(spark.createDataFrame(weeks, "doc_id int, start_day date, end_day date"), plans)
    assert not any("start_day" in x or "end_day" in x for x in re.findall(r"hashpartitioning\([^)]*\)", plan_of(got)) if "doc_id" in x)
    assert {r["doc_id"]: r["verdict"] for r in got.collect()} == {1: "pass", 2: "warning", 3: "warning", 4: "warning", 5: "warning", 6: "not_checked"}


def test_allocation_deals_rows_to_bounded_tasks(spark, monkeypatch):
    lines = spark.createDataFrame([(k, i, 7) for k in range(60) for i in range(5)], "k int, i int, amount int")
    plain = sorted(map(tuple, allocation.allocate(lines, ["k"], ["i"], "amount", 20).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    out = allocation.allocate(lines, ["k"], ["i"], "amount", 20)
    assert out.rdd.getNumPartitions() == 15 and sorted(map(tuple, out.collect())) == plain


HOURS = "struct<theory: int, practice: int, total: int>"
POSITIONS = f"doc_id int, pos int, kind string, number string, title string, parent_section string, hours {HOURS}"


def plans_of(spark):
    """Plans with two sections of one title, a topic of no section, negative and missing hours, two totals rows, none, and one that is not in the workload."""
    rows = [(1, 1, "section", "1", "A", None, (4, 2, 6)), (1, 2, "topic", None, "a", "A", (3, 1, 4)), (1, 3, "topic", "1.1", "b", "A", (1, -1, 0)), (1, 9, "total", None, "t", None, (9, 9, 9)), (1, 10, "total", None, "t", None, (4, 1, 5))]
    rows += [(2, 1, "section", "1", "A", None, (1, 1, 2)), (2, 2, "topic", None, "a", "A", (1, None, 1)), (2, 5, "section", "2", "A", None, (0, 0, 0)), (2, 6, "topic", None, "lost", None, (1, 1, 2))]
    rows += [(3, 1, "section", "1", "A", None, (9, 0, 9)), (3, 2, "topic", None, "a", "A", (9, 0, 9)), (3, 3, "total", None, "t", None, (9, 0, 9)), (4, 1, "topic", None, "a", "A", (1, 0, 1))]
    return spark.createDataFrame(rows, POSITIONS), spark.createDataFrame([(1, 2, 3), (2, 1, 2), (3, 2, 3), (5, 1, 1), (6, None, 1)], "doc_id int, study_weeks int, hours_per_week int")


def test_schedule_checks_read_the_schedule_once(spark, monkeypatch):
    positions, load = plans_of(spark)
    for rows in (session.TASK_ROWS, 2):
        monkeypatch.setattr(session, "TASK_ROWS", rows)
        made = schedule.build_schedule(positions, load)
        assert sorted((r["doc_id"], r["seq"], r["title"], r["part_type"], r["week"], r["hours"]) for r in made.collect()) == [
            (1, 1, "a", "theory", 1, 3), (1, 2, "a", "practice", 2, 1), (1, 3, "b", "theory", 2, 1), (2, 1, "a", "theory", 1, 1), (2, 3, "a", "theory", 1, 1), (3, 1, "a", "theory", 1, 3), (3, 1, "a", "theory", 2, 3), (3, 1, "a", "theory", 3, 3),
        ]
        got = schedule.validate_schedule(made, positions, load)
        plan = plan_of(got)
        assert {r["doc_id"]: r["failed"] for r in got.collect()} == {1: ["empty_hours"], 2: ["total_row_missing", "positions"], 3: ["overload"], 5: ["total_row_missing", "empty_hours"], 6: ["total_row_missing"]}
        assert len(re.findall(r"\bWindow \[", plan)) == 2 and len(re.findall(r"\bExchange ", plan)) == 4


def test_plan_checks_read_the_schedule_once(spark):
    positions, load = plans_of(spark)
    got = audit.plan_checks(positions, schedule.build_schedule(positions, load))
    plan = plan_of(got)
    assert {r["doc_id"]: r["verdict"] for r in got.collect()} == {1: "pass", 2: "not_checked", 3: "pass", 4: "not_checked"}
    assert len(re.findall(r"\bWindow \[", plan)) == 2


def test_hour_checks_deal_plans_to_bounded_tasks(spark, monkeypatch):
    positions, _ = plans_of(spark)
    monkeypatch.setattr(session, "TASK_ROWS", 2)
    got = audit.hour_checks(positions)
    plan = plan_of(got)
    assert {(r["doc_id"], r["check_id"]): r["verdict"] for r in got.collect()} == {(d, c): v for d, *both in ((1, "pass", "warning"), (2, "pass", "not_checked"), (3, "pass", "pass"), (4, "pass", "not_checked")) for c, v in zip(("topic_hours", "theory_practice_hours"), both)}
    assert re.findall(r"hashpartitioning\(doc_id#\d+, (\d+)\)", plan) == ["7"]
