"""Every registered query runs, and gives what its SQL gives in DuckDB."""

from __future__ import annotations

import os
from datetime import date

import duckdb
import pytest

from plansmith.plans import audit, catalogue_more  # noqa: F401 (registers more queries)
from plansmith.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def values(frame):
    cols = sorted(frame.columns)
    return sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tmp_path, name):
    QUERIES[name](spark, DATA).write.parquet(str(tmp_path / "out"))
    got = duck.sql(f"SELECT * FROM '{tmp_path}/out/*.parquet'").fetchdf()
    if name in SQL:
        want = duck.sql(SQL[name]).fetchdf()
        assert sorted(want.columns) == sorted(got.columns)
        assert values(want) == values(got)


def test_audit(spark):
    plans = spark.createDataFrame([("a", 2026), ("b", 2019)], "doc_id string, start_year int")
    registry = audit.registry_checks(plans, [(date(2022, 9, 1), None), (None, date(2030, 1, 1))])
    programmes = spark.createDataFrame([("a", "7-9 лет", 2, 1, ["знает"], "2026–2027", "2026–2027", ["Промежуточная аттестация"]), ("b", " ", None, 3, [], None, "2026–2027", None)], "doc_id string, student_age string, duration_years int, study_year_number int, expected_results array<string>, academic_year string, plan_academic_year string, attestation_statements array<string>")
    traces = spark.createDataFrame([("a", "Итоговая Аттестация")], "doc_id string, text string")
    facts = spark.createDataFrame([("a", 72, 72, 72, "document"), ("b", 72, None, 70, "derived")], "doc_id string, hours_per_year int, stated_schedule_hours int, total_hours int, provenance string")
    h = "struct<total: int, theory: int, practice: int>"
    positions = spark.createDataFrame([("a", 1, "topic", (2, 1, 1)), ("a", 2, "total", (2, 1, 1)), ("b", 1, "topic", (3, 1, 1))], f"doc_id string, pos int, kind string, hours {h}")
    week = "doc_id string, week int, start_day date, end_day date, lesson_type string, theory_hours int, practice_hours int"
    calendar = spark.createDataFrame([("a", 1, date(2026, 9, 7), date(2026, 9, 13), "беседа", 2, 0), ("b", 1, date(2026, 12, 28), date(2027, 1, 3), "игра", 2, 0), ("b", 2, date(2026, 9, 1), date(2026, 9, 6), None, 0, 2)], week)
    loads = spark.createDataFrame([("a", 2), ("b", 2)], "doc_id string, hours_per_week int")
    rows = audit.report(registry, audit.programme_checks(programmes), audit.attestation_check(programmes, traces), audit.workload_checks(facts), audit.hour_checks(positions), audit.calendar_checks(calendar, loads))
    got = {r["doc_id"]: r for r in audit.summary(rows).collect()}
    assert got["a"]["warnings"] == 0 and got["a"]["not_checked"] == 0 and got["a"]["passed"] == 15
    assert got["b"]["warned"] == ["age_found", "duration_found", "expected_results", "registry_in_force", "short_week_full_load", "topic_hours", "type_vs_hours", "vacation_gap", "weekly_load", "yearly_hours"]


def test_streaming(spark, tmp_path):
    from .test_planning import FIVE, document, table

    from plansmith.streaming.ingest import file_stream, ingest_plans

    folder = tmp_path / "in"
    folder.mkdir()
    for i in (1, 2):
        (folder / f"{i}.docx").write_bytes(document(table(FIVE)))
        ingest_plans(file_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("doc_id", "batch").distinct().count() == 2 and out.where("kind = 'topic'").count() == 8
