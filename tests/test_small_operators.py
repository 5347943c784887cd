"""Matches that must hold, histories of versions, lookups, readers and forms of practice, on small tables."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from plansmith.functions import text as tx
from plansmith.operators import rounds
from plansmith.plans import clauses, registry, schedule
from plansmith.sources import uploads


def test_matched_rows(spark):
    ours = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    theirs = spark.createDataFrame([(2, "b", 2.0), (1, "z", 1.0)], "k int, x string, y double")
    got = rounds.matched_rows(ours.where("k IS NOT NULL"), theirs, ["k"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "a", 1.0), (2, "b", 2.0)]
    for a, b in ((ours, theirs), (ours.where("k = 1"), theirs), (ours.where("k IS NOT NULL"), theirs.union(theirs.where("k = 1")))):
        with pytest.raises(Exception, match="rows do not match"):
            rounds.matched_rows(a, b, ["k"]).collect()
    assert rounds.matched_rows(ours.limit(0), theirs.limit(0), ["k"]).count() == 0


def test_history_faults(spark):
    rows = [("a", 1, date(2020, 1, 1)), ("a", 2, date(2021, 1, 1)), ("a", 3, date(2020, 6, 1)), ("b", 1, None), ("b", 1, date(2020, 1, 1)), ("c", None, date(2030, 1, 1)), ("c", 2, date(2020, 1, 1)), ("d", 1, date(2022, 1, 1)), ("d", 2, None)]
    df = spark.createDataFrame(rows, "number string, version int, effective_from date")
    got = sorted((r["number"], r["version"] or 0, r["rule"]) for r in registry.history_faults(df).collect())
    assert got == [("a", 3, "order"), ("b", 1, "repeated_version"), ("b", 1, "repeated_version"), ("c", 0, "no_version")]
    assert registry.history_faults(df.limit(0)).count() == 0


def test_lookups_and_readers(spark):
    row = spark.range(1).select(*[clauses.looked_up(F.lit(x), clauses.VERB_OF_NOUN) for x in ("Выбор", "расчёт", "стол")], *[uploads.programme_reader(F.lit(x)) for x in ("a.DOCX", "b.doc", "c.pdf", None)]).first()
    assert tuple(row) == ("выбирает", "рассчитывает", None, "docx", "doc", None, None)
    zipped = spark.range(1).select(rounds.zipped(F.array(F.lit(1), F.lit(2)), F.array(F.lit("x")))).first()[0]
    assert [tuple(z) for z in zipped] == [(1, "x"), (2, None)]


def test_ordered_calendar(spark):
    df = spark.createDataFrame([(2, 1), (1, 3), (1, 2)], "doc_id int, week int")
    assert [tuple(r) for r in schedule.ordered_calendar(df).collect()] == [(1, 2), (1, 3), (2, 1)]


@pytest.mark.parametrize(("n", "items", "want"), [(8, 3, "0, 1, 2"), (2, 3, "0, 1…"), (3, 3, "0, 1, 2"), (2, 0, "")])
def test_first_of_list(spark, n, items, want):
    df = spark.createDataFrame([([str(i) for i in range(items)],)], "x array<string>")
    assert df.select(tx.first_of_list(F.col("x"), n)).first()[0] == want


def test_upload_purposes(spark):
    rows = [("plan", "x", 2, 1, None, None, None), ("plan", "x", 2, 0, None, None, "content"), ("programme", "Календарный план, тип занятия, вид контроля", 0, 0, 3, True, "calendar"), ("programme", None, 0, 0, 3, True, None), ("programme", "", 0, 0, 3, False, "content"), ("template", "тип занятия, вид контроля, планируемый результат", None, None, None, None, None), ("template", "x", 1, 1, 1, True, "content"), ("plan", "Федеральный закон", 2, 2, 2, True, "normative")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, t string, a int, b int, c int, d boolean, want string")
    fault = uploads.purpose_fault(*[F.col(c) for c in ("p", "t", "a", "b", "c", "d")])
    assert [(r["f"], r["want"]) for r in df.select("i", "want", fault.alias("f")).orderBy("i").collect()] == [(r[-1], r[-1]) for r in rows]
