"""Plans from Word documents to calendar rows, on small hand-made documents."""

from __future__ import annotations

import io
import random
import re
import zipfile
from difflib import SequenceMatcher
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from plansmith.functions import calendar as cal
from plansmith.functions import text as tx
from plansmith.operators import allocation, matching
from plansmith.plans import schedule as sch
from plansmith.plans.catalogue import QUERIES
from plansmith.plans.planning import in_force, verdict, workload_provenance
from plansmith.sources import docx
from plansmith.sources.plan_tables import parse_plans, plan_metadata, score_tables, table_rows

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, bold=False, align=None):
    jc = f'<w:pPr><w:jc w:val="{align}"/></w:pPr>' if align else ""
    return f"<w:p>{jc}<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t>{escape(text)}</w:t></w:r></w:p>"


def table(rows):
    cell = lambda c: f"<w:tc>{''.join(paragraph(p) for p in (c if isinstance(c, list) else [c]))}</w:tc>"
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows) + "</w:tbl>"


def document(*body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {NS}><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


FIVE = [["№", "Тема", "всего часов", "теория", "практика"], ["1", "Раздел первый", "4", "2", "2"], ["1.1", "Введение", "2", "2", "0"], ["1.2", "Практика", "2", "-", "2"], ["2", "Раздел второй", "6", "2", "4"], ["2.1", "Теория раздела", "2", "2", "0"], ["2.2", "Практика раздела", "4", "0", "4"], ["Итого", "", "10", "4", "6"]]
CALENDAR = [["Месяц", "Неделя", "Теоретические занятия", "Практические занятия", "Планируемый результат", "Вид контроля", "a", "b"]] * 2
COMPACT = [["Темы", "Всего часов", "Теория", "Практика"], ["", "", "", ""], [["1. Введение", "1.1 Туризм", "1.2 Знакомство"], ["2", "1", "", "1"], ["1", "1", "", "0"], ["1", "", "", "1"]], [["2. Второй раздел", "2.1 Третья тема"], ["2", "2"], ["1", "1"], ["1", "1"]], ["Всего часов:", "4", "2", "2"]]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    facts = [paragraph("Количество часов в неделю: 2"), paragraph("5 учебных недель на 10 часов"), paragraph("Заголовок", True, "center")]
    bad = [r if r[0] != "Всего часов:" else r for r in COMPACT]
    bad = bad[:3] + [[["2. Второй раздел", "2.1 Третья тема"], ["2", "2"], ["1", "2"], ["1", "1"]]] + bad[4:]
    for name, content in {"five.docx": document(*facts, table(CALENDAR), table(FIVE)), "compact.docx": document(table(COMPACT)), "bad.docx": document(table(bad)), "none.docx": document(paragraph("x")), "broken.docx": b"PK\x03\x04broken"}.items():
        (folder / name).write_bytes(content)
    return docx.read_files(spark, str(folder))


def named(df):
    return df.withColumn("doc_id", F.regexp_extract("doc_id", r"([^/]+)\.docx$", 1))


def test_sources(files):
    assert {r["name"]: r["status"] for r in docx.check_uploads(files).collect()} == {"five.docx": "ok", "compact.docx": "ok", "bad.docx": "ok", "none.docx": "ok", "broken.docx": "ok"}
    p = named(docx.paragraphs(files)).where("doc_id = 'five'").orderBy("pos").collect()
    assert [(r["text"], r["is_bold"], r["alignment"]) for r in p][-1] == ("Заголовок", True, "center") and len(p) == 3
    facts = named(plan_metadata(docx.paragraphs(files))).where("doc_id = 'five'").first()
    assert (facts["hours_per_week"], facts["study_weeks"], facts["stated_schedule_hours"]) == (2, 5, 10)
    scores = {(r["doc_id"], r["table_pos"]): r["score"] for r in named(score_tables(table_rows(docx.cells(files)))).collect()}
    assert scores["five", 0] == -1 and scores["five", 1] == 3 + 2 + 2 + 2 + 1 + 5 + 2


def plans(files):
    return named(parse_plans(docx.cells(files))).cache()


def test_plans(files):
    rows = plans(files).orderBy("doc_id", "pos").collect()
    of = lambda d, k: [(r["number"], r["title"], tuple(r["hours"]), r["parent_section"]) for r in rows if r["doc_id"] == d and r["kind"] == k]
    assert of("five", "section") == [("1", "Раздел первый", (4, 2, 2), None), ("2", "Раздел второй", (6, 2, 4), None)]
    assert of("five", "topic") == [("1.1", "Введение", (2, 2, 0), "Раздел первый"), ("1.2", "Практика", (2, 0, 2), "Раздел первый"), ("2.1", "Теория раздела", (2, 2, 0), "Раздел второй"), ("2.2", "Практика раздела", (4, 0, 4), "Раздел второй")]
    assert [t[2] for t in of("five", "total")] == [(10, 4, 6)]
    assert [(t[0], t[2]) for t in of("compact", "topic")] == [("1.1", (1, 1, 0)), ("1.2", (1, 0, 1)), ("2.1", (2, 1, 1))]
    errors = {r["doc_id"]: r["title"] for r in rows if r["kind"] == "error"}
    assert errors == {"bad": "total=2, theory=2, practice=1"}


def test_schedule(spark, files):
    positions = plans(files).where("kind != 'error'")
    workload = spark.createDataFrame([("five", 5, 2, 2026), ("compact", 3, 2, 2027)], "doc_id string, study_weeks int, hours_per_week int, start_year int")
    s = sch.build_schedule(positions, workload)
    five = [(r["week"], r["title"], r["part_type"], r["hours"]) for r in s.where("doc_id = 'five'").orderBy("seq", "week").collect()]
    assert five == [(1, "Введение", "theory", 2), (2, "Практика", "practice", 2), (3, "Теория раздела", "theory", 2), (4, "Практика раздела", "practice", 2), (5, "Практика раздела", "practice", 2)]
    assert {r["doc_id"]: r["failed"] for r in sch.validate_schedule(s, positions, workload).collect()} == {"five": [], "compact": ["empty_hours"]}
    items = spark.createDataFrame([("five", 1, "1.1", "Введение", "Содержание один", "A"), ("five", 2, None, "ПРАКТИКА!", "Два", "A"), ("five", 3, "2.1", "Иное", "Три", "B"), ("five", 4, None, "Практика раздела подробно", "Четыре", "B"), ("compact", 1, None, "Введение", "чужое", None)], "doc_id string, pos int, number string, title string, content string, parent_section string")
    m = sch.match_items(positions, items)
    assert {(r["doc_id"], r["pos"]): (r["item_pos"], r["status"]) for r in m.where("doc_id = 'five'").collect()} == {("five", 2000): (1, "EXACT"), ("five", 3000): (2, "NORMALIZED"), ("five", 5000): (3, "NUMBER_MATCH"), ("five", 6000): (4, "TEXT_MATCH")}
    assert {r["status"] for r in m.where("doc_id = 'compact'").collect()} == {"NOT_MATCHED"}
    rows = sch.calendar_rows(sch.week_parts(s, positions, m, items), workload).orderBy("doc_id", "week").collect()
    five = [r for r in rows if r["doc_id"] == "five"]
    assert [(r["date_range"], r["topic_title"], r["total_hours"], r["program_content_full"]) for r in five][:2] == [("01–06.09", "Введение", 2, "Содержание один"), ("07–13.09", "Практика", 2, "Два")]
    two = [r for r in rows if r["doc_id"] == "compact"][0]
    assert two["topic_title"] == "Туризм" and two["total_hours"] == 2 and len(two["parts"]) == 2 and len(two["warnings"]) == 2


def test_validate_plan(spark):
    h = "struct<total: int, theory: int, practice: int>"
    positions = spark.createDataFrame([("a", 1, "section", "1", "S", (4, 2, 2), None, False), ("a", 2, "topic", "1.1", "T", (3, 2, 2), "S", False), ("a", 9, "total", None, "", (72, 20, 40), None, False)], f"doc_id string, pos int, kind string, number string, title string, hours {h}, parent_section string, standalone boolean")
    facts = spark.createDataFrame([("a", 72, 36, 2, None)], "doc_id string, hours_per_year int, study_weeks int, hours_per_week int, stated_schedule_hours int")
    assert sorted(r["check_id"] for r in sch.validate_plan(positions, facts).collect()) == ["section_hours", "topic_hours", "total_row", "total_sum"]
    wrong = facts.withColumn("stated_schedule_hours", F.lit(70))
    assert sch.validate_plan(positions, wrong).where("check_id = 'yearly_hours'").first()["detail"] == "72; 72; 70; 72"


def test_allocation_equals_a_greedy_loop(spark):
    rng = random.Random(1)
    rows, want = [], []
    for plan in range(60):
        cap, week, used = 5, 1, 0
        for pos in range(rng.randint(0, 12)):
            amount = rng.choice([0, 1, 2, 5, rng.randint(1, 17)])
            rows.append((plan, pos, amount))
            while amount:
                part = min(amount, cap - used)
                want.append((plan, pos, week, part))
                amount, used = amount - part, used + part
                if used == cap:
                    week, used = week + 1, 0
    df = spark.createDataFrame(rows, "plan int, pos int, amount int")
    got = allocation.allocate(df, ["plan"], ["pos"], "amount", 5)
    assert sorted((r["plan"], r["pos"], r["week"], r["hours"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize(("units", "slots", "want"), [(12, 3, [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]), (4, 4, [[0], [1], [2], [3]]), (4, 5, [[0], [1], [2], [3], [3]]), (2, 5, [[0], [0], [1], [1], [1]])])
def test_slots(spark, units, slots, want):
    rows = allocation.assign_slots(spark.range(units).withColumn("k", F.lit(1)), ["k"], ["id"], slots).collect()
    got = [sorted(r["unit"] for r in rows if r["slot"] == s) for s in range(slots)]
    assert got == want
    assert [r["continued"] for r in sorted(rows, key=lambda r: (r["slot"], r["unit"]))] == [u in want[s - 1] if s else False for s, us in enumerate(want) for u in us]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    years = ["2026-2027", "2026–2027", "2026/27", "план на 2026 - 2027 учебный", "2026–2028", "2026", "1999/00"]
    assert one(spark, *[cal.academic_year(F.lit(y)) for y in years]) == (*["2026–2027"] * 4, None, None, "1999–2000")
    assert one(spark, *[tx.hours_word(F.lit(n)) for n in (1, 2, 5, 11, 21, 112)]) == ("час", "часа", "часов", "часов", "час", "часов")
    assert one(spark, tx.clean_spaces(F.lit("  a \n b ")), tx.normalise_title(F.lit("Ёлка — и  №1!")), tx.lenient_integer(F.lit(" – ")), tx.lenient_integer(F.lit("12 ч"))) == ("a b", "елка и 1", 0, 12)
    assert one(spark, tx.clause_units(F.lit("Поход в г. Псков. Игра; беседа!\nИтог")))[0] == ["Поход в г. Псков", "Игра", "беседа!", "Итог"]
    assert one(spark, tx.preview(F.lit("x" * 321)), tx.preview(F.lit("x" * 320))) == ("x" * 319 + "…", "x" * 320)
    assert one(spark, *tx.number_and_title(F.lit("1.2. Тема  а")), *tx.number_and_title(F.lit("Тема"))) == ("1.2", "Тема а", None, "Тема")
    work = [workload_provenance(*[F.lit(x).cast("int") for x in v]) for v in ((72, 36, 2), (72, 36, None), (72, None, 2), (72, None, None), (70, None, None), (70, 0, None))]
    assert one(spark, *work) == ("document", "derived", "derived", "derived_36x2", None, None)
    assert one(spark, verdict(F.lit(None).cast("boolean")), verdict(F.lit(True)), verdict(F.lit(False))) == ("not_checked", "pass", "warning")
    day = lambda d: F.lit(d).cast("date")
    assert one(spark, in_force(day("2026-08-31"), day(None), F.lit(2025)), in_force(day("2026-09-01"), day(None), F.lit(2025)), in_force(day(None), day("2026-08-30"), F.lit(2026))) == (True, False, False)


def test_week_grid(spark):
    grid = {(r["start_year"], r["week"]): r for r in cal.week_grid(spark.createDataFrame([(2026,), (2027,)], "start_year int")).collect()}
    assert len(grid) == 72
    assert [grid[2026, w]["date_range"] for w in (1, 2, 17, 18, 19, 36)] == ["01–06.09", "07–13.09", "21–27.12", "28–30.12", "11–17.01", "10–16.05"]
    assert grid[2026, 5]["date_range"] == "28.09–04.10" and grid[2026, 5]["month_label"] == "Сентябрь / Октябрь" and grid[2026, 18]["month_label"] == "Декабрь"
    assert str(grid[2027, 1]["start_day"]) == "2027-09-01" and str(grid[2027, 1]["end_day"]) == "2027-09-05"
    assert all((grid[2027, w + 1]["start_day"] - grid[2027, w]["end_day"]).days == 1 for w in range(1, 36))


def test_fuzzy_match_all_pairs(spark, tmp_path):
    """Every line of the benchmark texts against every document line, as difflib scores them."""
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=k)) for k in (1, 2, 3, 5, 8, 13, 20, 40, 60) for _ in range(4)] + ["that and onesen erblest it hein ti", "план занятий на год"]

    def changed(line, share):
        return "".join(rng.choice(["", c + "x", "z"]) if rng.random() < share else c for c in line)

    docs = [changed(line, share) for line in base for share in (0, 0.03, 0.1, 0.2)[rng.randint(0, 1) :: 2]] + ["that and onesen erblezt it hein ti"]
    items = [(i, "\n".join(base[k : k + 3])) for i, k in enumerate(range(0, len(base), 3))]
    spark.createDataFrame([(i, "\n".join(docs[i::5])) for i in range(5)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    norm = lambda s: re.sub("[^a-zа-я0-9]+", " ", s.lower()).strip()
    lines = sorted({norm(d) for d in docs} - {""})
    want = {}
    for i, text in items:
        for k, line in enumerate(text.split("\n")):
            ratios = sorted(((SequenceMatcher(None, norm(line), d).ratio(), d) for d in lines), reverse=True)
            near = [d for r, d in ratios if ratios[0][0] - r < 0.08]
            if ratios[0][0] >= 0.82:
                want[i, k] = (near[0] if len(near) == 1 else None, round(ratios[0][0], 6), len(near))
    ids = {r["id"]: r["d"] for r in spark.createDataFrame([(d,) for d in lines], "d string").select("d", F.xxhash64("d").alias("id")).collect()}
    got = {(r["item_id"], r["line"]): (ids.get(r["item"]), r["ratio"], r["n_near"]) for r in QUERIES["fuzzy_match_topband"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 25 and len({v[2] for v in want.values()}) > 1


def test_shared_letters():
    rng = random.Random(9)
    for _ in range(300):
        x, y = ("".join(rng.choices("abcd e", k=rng.randint(0, 60))) for _ in range(2))
        row = [0] * (len(y) + 1)
        for c in x:
            old = row
            row = [0]
            for j, d in enumerate(y):
                row.append(old[j] + 1 if c == d else max(old[j + 1], row[j]))
        assert matching.shared_letters(x)(y) == row[-1] >= sum(b.size for b in SequenceMatcher(None, x, y).get_matching_blocks())


def test_fuzzy_match_asks_difflib_for_few_pairs(spark):
    """Lines with the same letters in another order: counts of letters let all pairs pass, the longest common subsequence hardly any."""
    rng = random.Random(5)
    lines = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz" * 3, 78)) for _ in range(40)]
    topics, items = (spark.createDataFrame([(x,) for x in lines[a:b]], f"{c} string") for a, b, c in ((0, 20, "x"), (20, 40, "y")))
    calls = spark.sparkContext.accumulator(0)
    plain = matching.SequenceMatcher

    def counting(*args):
        calls.add(1)
        return plain(*args)

    f = matching.ratio_from(0.82).func
    f.__globals__["SequenceMatcher"] = counting
    try:
        assert [r.isna().all() for r in f(iter([(topics.crossJoin(items).toPandas()["x"], topics.crossJoin(items).toPandas()["y"])]))] == [True]
    finally:
        f.__globals__["SequenceMatcher"] = plain
    assert calls.value == 0


def test_priority_match_sorts_in_many_tasks(spark, tmp_path):
    spark.createDataFrame([(i, f"part {i % 90}", f"type {i}", i % 60) for i in range(200)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    out = QUERIES["priority_match"](spark, str(tmp_path))
    assert "row_number()" not in out._jdf.queryExecution().toString() and out.count() == 200
