"""Choice of outcomes and clauses, neighbours, weeks, bags and files against plain loops over small texts of our own."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from plansmith.functions import text as tx
from plansmith.operators import bags
from plansmith.plans import audit, catalogue_content, clauses, outcomes, weeks  # noqa: F401 (registers queries)
from plansmith.plans.catalogue import QUERIES, SQL
from plansmith.sources import uploads

TOPICS = [
    ("p", 1, "Вязание узлов", "Виды узлов и верёвок. Вязание прямого узла на верёвке", "Вязание прямого узла", 0, 2, 0),
    ("p", 2, "Вязание узлов", "Виды узлов и верёвок. Вязание прямого узла на верёвке", "Вязание прямого узла", 0, 2, 1),
    ("p", 3, "Съедобные растения", "Съедобные растения леса: ягоды, орехи, травы", "Определение растений", 2, 0, 0),
    ("p", 4, "Совсем другое", None, None, 1, 1, 5),
    ("q", 1, "Вязание узлов", "Вязание", "", 1, 1, None),
    ("p", 5, "", "Ягоды и орехи, травы, узлов, верёвок, прямого, костюмы", "", 2, 0, 2),
]
OUTCOMES = [
    ("p", "knowledge", 0, "Названия узлов и верёвок"), ("p", "knowledge", 1, "Съедобные и ядовитые растения своего края"), ("p", "knowledge", 2, "правила поведения в группе"),
    ("p", "skill", 0, "Вязание узлов без подсказки"), ("p", "skill", 1, "Вязание узлов на время"), ("p", "skill", 2, "Названия узлов и верёвок"), ("p", "skill", 3, "  "), ("p", "skill", 4, "Ягоды, орехи и травы в г. Томске"),
    ("q", "skill", 0, "Вязание узлов, ремонт верёвок и сбор ягод" + " по карте" * 20),
]


def plain_choice(topics, stated, least=16):
    """Every topic against every outcome of its plan."""
    generic, out = outcomes.GENERIC_ROOTS, {}
    words = lambda x, stop: {w for w in re.findall("[а-яё]{4,}", (x or "").lower()) if w not in stop}

    def roots(x):
        found = {next((v for k, v in outcomes.SPECIAL_ROOTS.items() if w.startswith(k)), w[:6]) for w in words(x, outcomes.OUTCOME_STOP)}
        return {r for r in found if not any(r.startswith(g[:5]) or g.startswith(r) for g in generic)}

    for plan, key, topic, content, activity, th, pr, turn in topics:
        mine = [o for o in stated if o[0] == plan and o[3].strip()]
        skills_first = (pr and not th) or (pr >= th and not (th and not pr))
        scored = []
        for _, kind, pos, text in mine:
            kinds = {o[1] for o in mine if o[3] == text}
            a, b, c = (len(roots(x) & roots(text)) for x in (topic, content, activity))
            pre = sum(w[:4] in (content or "").lower() for w in words(text, outcomes.OUTCOME_STOP))
            if a == 0 and (b + c == 0 or (b + c < 2 and pre < 3)):
                score = -50
            else:
                score = 12 * a + 11 * b + 7 * c + pre + (45 if a > 1 else 12 if a else -8) + 2 * sum(w in text.lower() for w in words(topic, outcomes.TITLE_STOP))
                score += 5 * all(re.search(r"\bг\.\s*\w", x.lower()) for x in (text, f"{topic}\n{content or ''}")) - 16 * (a == 0 and th > 0 and pr == 0) - 2 * (len(text) > 180)
            score += 3 * (("skill" if skills_first else "knowledge") in kinds)
            if score >= least:
                pool = 2 * (a > 0 and ((th > 0 and not pr and "knowledge" in kinds) or (pr > 0 and not th and "skill" in kinds))) or int(a > 0)
                scored.append((-pool, -score, -a, text, kind, pos))
        if scored:
            best = sorted(x for x in scored if x[0] == min(scored)[0])
            near = [x for x in best if -x[1] >= -best[0][1] - 3 and -x[2] >= -best[0][2] - 1]
            x = near[(turn or 0) % len(near)]
            out[plan, key] = (x[3], -x[1], -x[2], len(near))
    return out


def test_outcome_choice(spark):
    topics = spark.createDataFrame(TOPICS, "plan string, topic_id int, topic string, content string, activity string, theory_hours int, practice_hours int, occurrence int")
    stated = spark.createDataFrame(OUTCOMES, "plan string, kind string, pos int, outcome string")
    got = outcomes.choose_outcomes(topics, stated, ["plan"])
    want = plain_choice(TOPICS, OUTCOMES)
    assert {(r["plan"], r["topic_id"]): (r["outcome"], r["score"], r["title_hits"], r["n_best"]) for r in got.collect()} == want
    assert ("p", 4) not in want and want["p", 1][0] != want["p", 2][0] and want["p", 3][0].startswith("Съедобные")
    low = outcomes.choose_outcomes(topics, stated, ["plan"], least=-10)
    assert {(r["plan"], r["topic_id"]): (r["outcome"], r["score"], r["title_hits"], r["n_best"]) for r in low.collect()} == plain_choice(TOPICS, OUTCOMES, -10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert outcomes.choose_outcomes(topics.limit(0), stated, ["plan"]).count() == 0


def test_fragment_score(spark):
    rows = [("Вязание узлов", "узлов"), ("понятие о лесе и травах?", ""), ("Экскурсия в музей: что это? зачем?", "музей леса"), ("Мероприятие «День леса» в г. Томске", ""), ("Отработка " + "шага " * 50, ""), ("Наблюдение за птицами и зверями в лесу весной", "птицами")]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x string, t string").orderBy("i").select(outcomes.fragment_score(F.col("x"), F.col("t"))).collect()]
    assert got == [-2 + 3, -6 - 3, 6 - 7 - 1 + 3 + 4, 5 + 3 + 4, 6 - 2, 6 + 3 + 4]


def test_fragment_choice_begins_words_as_its_sql(spark, tmp_path):
    """The SQL counts a sharp s as no letter, so a stem after it opens a word; after letters of its own range it does not."""
    texts = ["Titel hier\nAufeinßüber und so weiter im Satz.\nAufeinäüber und so weiter im Satz.", "Titel hier\nAufeinäüber und so weiter im Satz.\nAufeinßüber und so weiter im Satz."]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, QUERIES["fragment_choice"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(duck.execute(SQL["fragment_choice"]).fetchall()) and [r[3:] for r in got] == [(10, 1), (10, 2)]


def test_russian_stems_open_words_only(spark):
    rows = [("работа по карте", 1), ("заработа по карте", 0), ("ïработа", 0), ("-работа", 1)]
    got = [r[0] for r in spark.createDataFrame([(i, x, "") for i, (x, _) in enumerate(rows)], "i int, x string, t string").orderBy("i").select(outcomes.fragment_score(F.col("x"), F.col("t"))).collect()]
    assert got == [-2 + 6 * n for _, n in rows]


def test_clause_choice(spark):
    lesson = ["Виды костров", "Разжигание костра (одна спичка) в г. Томске", "Укладка рюкзака", "Составление меню", "Почему горит дерево?", "История спички"]
    rows = [(k, i, c, topic, None, th, occ) for k, topic, th, occ in (("a", "Костры в лесу", False, 0), ("b", "Костры в лесу", False, 1), ("t", "Костры в лесу", True, 0), ("n", "Плавание", False, 0)) for i, c in enumerate(lesson)]
    units = spark.createDataFrame(rows, "doc string, pos int, clause string, topic string, theory_text string, theory_only boolean, occurrence int").withColumn("turn", F.lit("kept"))
    got = clauses.select_clauses(units, ["doc"], "pos").collect()
    table = {(r["doc"], r["pos"]): r for r in got}
    assert [table["a", i]["action_class"] for i in range(6)] == [0, 3, 3, 3, 1, 1] and {r["turn"] for r in got} == {"kept"}
    assert [table["t", i]["action_class"] for i in range(6)] == [1, 1, 1, 1, 1, 1]
    assert table["a", 1]["hits"] == 1 and table["a", 1]["condition"] == 4 and table["a", 1]["specificity"] == 2 and table["a", 3]["specificity"] == 2
    assert {d: [p for (x, p), r in table.items() if x == d and r["chosen"]] for d in "abtn"} == {"a": [1], "b": [2], "t": [1], "n": [1]}
    assert [table["a", i]["rank"] for i in range(6)] == [None, 1, 2, 3, None, None]
    assert table["t", 4]["rank"] is None  # a question stands back


def plain_enriched(units, at, rules):
    """The rules one after the other over a list of clauses."""
    has = lambda p, x: re.search(p, x, re.I) is not None
    sel, used, got = units[at], {units[at]}, [(at, 0, 0, units[at])]

    def take(i, kind, parts):
        used.add(units[i])
        got.extend((i, k, kind, p) for k, p in enumerate(parts))

    for i in range(max(0, at - 1), min(len(units), at + 3)):
        if i != at and units[i] not in used and any(has(p, units[i]) and not has(p, sel) and not (u and has(u, sel)) for p, u in rules.frame):
            take(i, 1, [units[i]])
    for here, unless, there, practice in rules.wanted:
        if has(here, sel) and not (unless and has(unless, sel)):
            for i, x in enumerate(units):
                if x not in used and has(there, x):
                    parts = [p for p in re.split(r",\s+", x) if has(there, p)] if practice else []
                    take(i, 2 if practice else 1, parts or [x])
                    break
            break
    for i, x in enumerate(units):
        first = next((h for h, t in rules.obligatory if has(t, x)), None)
        if x not in used and not has(rules.never, x) and first and has(first, sel):
            parts = [p for p in re.split(r",\s+", x) if has(rules.focus[1], p)] if has(rules.focus[0], x) else []
            take(i, 3, parts or [x])
    return sel, ". ".join(x[3] for x in sorted(got)), [x[3] for x in sorted(got, key=lambda x: (x[2], x[0], x[1])) if x[2] >= 2]


LESSONS = [
    (["Виды лагерей", "Занятие на местности", "Разбивка лагеря", "Прогулка в г. Томск", "Занятие на местности", "Выбор места у воды", "Уход за палаткой, сушка одежды", "Упражнения с костром", "Определение места ночлега"], 2),
    (["Чистка котла", "Составление меню", "Разведение огня", "Подготовка дров, приготовление каши, сбор костра", "Закупка еды на костре", "Уборка привала", "Уборка привала"], 1),
    (["Работа со снаряжением, его ремонт, проверка, уход за ним", "Укладка рюкзака", "Составление план-графика"], 1),
    (["Составление плана", "Игра", "Сверка плана-графика, обед", "Список снаряжения"], 0),
    (["Упражнения в беге", "Бег на местности"], 0),
    (["одно"], 0),
]


def test_enriched_clauses(spark):
    rows = [(d, i, c, i == at) for d, (units, at) in enumerate(LESSONS) for i, c in enumerate(units)] + [(99, 0, "без выбора", None), (98, 0, None, True)]
    units = spark.createDataFrame(rows, "doc int, pos int, clause string, chosen boolean")
    got = {r["doc"]: (r["selected"], r["source"], r["added"]) for r in clauses.enrich_chosen(units, ["doc"], "pos", "clause", "chosen").collect()}
    want = {d: plain_enriched(*x, clauses.NEIGHBOURS) for d, x in enumerate(LESSONS)}
    assert {d: x for d, x in got.items() if d < 90} == want and 99 not in got
    assert sum(len(x[2]) for x in want.values()) >= 5
    plan = clauses.enrich_chosen(units, ["doc"], "pos", "clause", "chosen")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_attached_clauses(spark):
    rows = [(1, i, c) for i, c in enumerate(["«Лесные были», «Сказки»", "Игра.", "«Салки», «Прятки» .", "жмурки, догонялки", "Укладка рюкзака", "палатка"])]
    df = spark.createDataFrame(rows, "doc int, pos int, clause string").withColumn("opens", F.lit(1))
    got = clauses.attach_dependents(df, ["doc"], "pos", "clause", clauses.dependent_catalogue(F.col("clause"))).orderBy("block").collect()
    assert [(r["block"], r["first_pos"], r["clause"], r["n_parts"]) for r in got] == [(1, 0, "«Лесные были», «Сказки»", 1), (2, 1, "Игра: «Салки», «Прятки»: жмурки, догонялки", 3), (3, 4, "Укладка рюкзака", 1), (4, 5, "палатка", 1)]


def plain_form(parts):
    forms = list(dict.fromkeys(p[0].strip() for p in parts if p[0] and p[0].strip()))
    th, pr = sum(p[1] or 0 for p in parts), sum(p[2] or 0 for p in parts)
    has = [any(p[i] and p[i].strip() for p in parts) for i in (3, 4)]
    special = lambda x: bool(x) and x not in weeks.GENERIC
    only = forms[0] if len(forms) == 1 else ""
    of_practice = set(p[0].strip() for p in parts if p[2] and p[0] and p[0].strip())
    if th and not pr:
        out = weeks.THEORY
    elif pr and not th:
        out = only if special(only) else weeks.PRACTICE
    elif th and pr and not all(has):
        out = parts[0][0] if len(parts) == 1 and parts[0][0] != weeks.COMBINED else weeks.MIXED
    elif th and pr:
        one = of_practice.pop() if len(of_practice) == 1 else ""
        out = only if special(only) else one if special(one) else weeks.MIXED
    else:
        out = only or parts[0][0]
    single = bool(out) and out not in (weeks.COMBINED, "игра и викторина", "лекция, игра", "стол") and bool(out.strip())
    return out if single else weeks.MIXED if th and pr else weeks.PRACTICE if pr else weeks.THEORY


def test_week_forms_whole_table(spark):
    forms = [None, "экскурсия", weeks.THEORY, weeks.PRACTICE, weeks.COMBINED, "игра и викторина"]
    singles = [[(f, a, b, t, p)] for f, a, b, t, p in itertools.product([*forms, "лекция, игра", "стол"], (0, 2, None), (0, 1), ("x", " "), ("y", None))]
    doubles = [[(f, 1, 0, "x", None), (g, 0, b, None, t)] for f, g, b, t in itertools.product(forms, forms, (0, 1), ("y", ""))]
    every = singles + doubles
    rows = [(k, i, *p) for k, parts in enumerate(every) for i, p in enumerate(parts)]
    df = spark.createDataFrame(rows, "week int, pos int, lesson_type string, theory_hours int, practice_hours int, theory_text string, practice_text string")
    got = {r["week"]: r["lesson_type"] for r in weeks.week_forms(df, ["week"], "pos").collect()}
    assert got == {k: plain_form(parts) for k, parts in enumerate(every)}


def test_merged_weeks(spark):
    cases = {
        1: (["Строит шалаш.", "строит плот", "Строит шалаш"], "Строит шалаш и плот."), 2: (["Строит шалаш", "Рисует план."], "Строит шалаш. Рисует план."), 3: (["Знает лес", "Знает лес и поле", ""], "Знает лес и поле."),
        4: (["Отвечает по теме „Лес“.", "Отвечает по теме „Лес“.", "x"], "Отвечает по теме „Лес“. x"), 5: ([], ""), 6: ([None, "Поёт"], "Поёт."), 7: (["Лес", "Поле"], "Лес. Поле."), 8: (["Строит мост", "Строит дом", "Строит сад."], "Строит мост, дом и сад."),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k int, r array<string>")
    assert {r["k"]: r["x"] for r in df.select("k", weeks.merged_results(F.col("r")).alias("x")).collect()} == {k: v[1] for k, v in cases.items()}
    parts = [(1, 0, "экскурсия", 1, 0, "a", None, "Строит дом.", "проверка плана"), (1, 1, "экскурсия", 0, 1, None, "b", "Строит сад", "проверка отчёта"), (2, 0, None, 1, 0, "a", None, "Знает", None)]
    merged = weeks.merge_weeks(spark.createDataFrame(parts, "w int, pos int, lesson_type string, theory_hours int, practice_hours int, theory_text string, practice_text string, result string, control string"), ["w"], "pos")
    assert {r["w"]: (r["lesson_type"], r["result"], r["control"]) for r in merged.collect()} == {1: ("экскурсия", "Строит дом и сад.", "проверка плана и отчёта"), 2: (weeks.THEORY, "Знает", "")}
    assert spark.range(1).select(tx.merged_controls(F.array(F.lit("Устный опрос по лесу"), F.lit("устный опрос по полю")))).first()[0] == "устный опрос по лесу и полю"


def test_strongest(spark):
    def stay(group):
        if len(group) < 2:
            return list(range(len(group)))
        pool = [i for i, g in enumerate(group) if g[2]] or list(range(len(group)))
        best = max(pool, key=lambda i: (group[i][1], -len(group[i][0])))
        threes = sum(group[i][1] >= 3 for i in pool)
        if len(group) < 3 and threes != 1:
            return list(range(len(group)))
        return [i for i, g in enumerate(group) if g[0] == group[best][0] or g[2]]

    options = [("раз", 0, False), ("раздва", 3, True), ("три", 1, True), ("четыре", 2, False), ("раз", 0, True)]
    groups = [list(g) for n in (1, 2, 3) for g in itertools.product(options, repeat=n)]
    df = spark.createDataFrame([(k, i, *g) for k, group in enumerate(groups) for i, g in enumerate(group)], "k int, pos int, phrase string, s int, f boolean")
    got = Counter((r["k"], r["pos"]) for r in weeks.keep_strongest(df, ["k"], "pos", "phrase", F.col("s"), F.col("f")).collect())
    assert got == Counter((k, i) for k, g in enumerate(groups) for i in stay(g))


def test_bags(spark):
    schema = "doc int, a string, b int"
    ours = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (1, None, 2), (2, "y", 1), (3, "z", 1), (5, "q", 1), (5, "q", 1)], schema)
    theirs = spark.createDataFrame([(1, "x", 1), (1, None, 2), (1, "w", 9), (2, "y", 1), (4, "z", 1), (5, "q", 1)], schema)
    got = {r["doc"]: (r["verdict"], r["n_missing"], r["n_extra"]) for r in bags.bag_verdict(ours, theirs, ["doc"], ["a", "b"]).collect()}
    assert got == {1: ("warning", 1, 1), 2: ("pass", 0, 0), 3: ("not_checked", 1, 0), 4: ("not_checked", 0, 1), 5: ("warning", 1, 0)}
    assert {r["doc"]: r["verdict"] for r in bags.set_verdict(ours, theirs, ["doc"], ["a", "b"]).collect()}[5] == "pass"
    assert Counter(tuple(r) for r in bags.bag_difference(ours, theirs, ["doc"], ["a", "b"]).collect()) == Counter({(1, "x", 1, "missing", 1): 1, (1, "w", 9, "extra", 1): 1, (3, "z", 1, "missing", 1): 1, (4, "z", 1, "extra", 1): 1, (5, "q", 1, "missing", 1): 1})
    assert bags.bag_verdict(ours.limit(0), theirs.limit(0), ["doc"], ["a", "b"]).count() == 0


def test_plan_and_grid_checks(spark):
    hours = "struct<theory: int, practice: int, total: int>"
    positions = spark.createDataFrame([(d, p, kind, n, t, s, h) for d, off in ((1, 0), (2, 1), (3, 0)) for p, kind, n, t, s, h in ((0, "topic", "1.1", "Лес", "Природа", (1, 1, 2)), (1, "topic", None, "Поле", None, (2, 0, 2)), (2, "total", None, "Итого", None, (3, 1 + off, 4)))], f"doc_id int, pos int, kind string, number string, title string, parent_section string, hours {hours}")
    rows = [(d, n, t, s, k, w, h) for d in (1, 2) for n, t, s, k, w, h in (("1.1", "Лес", "Природа", "theory", 1, 1), ("1.1", "Лес", "Природа", "practice", 1, 1), (None, "Поле", "Поле", "theory", 2, 2))]
    schedule = spark.createDataFrame(rows + [(4, None, "x", "x", "theory", 1, 1)], "doc_id int, number string, title string, section string, part_type string, week int, hours int")
    assert {r["doc_id"]: r["verdict"] for r in audit.plan_checks(positions, schedule).collect()} == {1: "pass", 2: "warning", 3: "not_checked", 4: "not_checked"}
    lost = schedule.where("title != 'Поле'")
    assert {r["doc_id"]: r["verdict"] for r in audit.plan_checks(positions, lost).collect()}[1] == "warning"
    from plansmith.functions.calendar import week_grid

    grid = week_grid(spark.createDataFrame([(2026,)], "start_year int")).select("start_day", "end_day").collect()
    days = [(1, *r) for r in grid] + [(2, *r) for r in grid[:-1]] + [(3, *r) for r in [*grid, grid[0]]] + [(4, *grid[0])]
    weeks_of = spark.createDataFrame(days, "doc_id int, start_day date, end_day date")
    plans = spark.createDataFrame([(1, 2026), (2, 2026), (3, 2026), (4, 2025), (5, 2026), (6, None)], "doc_id int, start_year int")
    assert {r["doc_id"]: r["verdict"] for r in audit.grid_checks(weeks_of, plans).collect()} == {1: "pass", 2: "warning", 3: "warning", 4: "warning", 5: "not_checked", 6: "not_checked"}


def archive(members, method=zipfile.ZIP_DEFLATED):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return raw.getvalue()


def test_archive_faults(spark):
    good = {"[Content_Types].xml": "<a/>", "word/document.xml": "слово " * 1000}
    whole, stored = archive(good), archive(good, zipfile.ZIP_STORED)
    at = stored.index("слово".encode())
    files = {"good": whole, "stored": stored, "flipped": stored[:at] + b"\x00" + stored[at + 1 :], "cut": whole[: len(whole) // 2], "bare": archive({"a": "b"}), "text": b"plain", "empty": b"", "null": None, "bomb": archive({**good, "big": b"0" * 5_000_000})}
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "name string, content binary")
    got = {r["name"]: r["archive_fault"] for r in uploads.archive_faults(df, most=1_000_000).collect()}
    assert got == {"good": None, "stored": None, "flipped": "damaged", "cut": "damaged", "bare": "members", "text": "damaged", "empty": "damaged", "null": "damaged", "bomb": "unpacked_size"}
    assert len(df.columns) == 2 and uploads.archive_faults(df.limit(0)).count() == 0


@pytest.mark.parametrize(("change", "fault"), [(None, None), ("tables", "tables"), ("columns", "columns"), ("rows", "rows"), ("markers", "markers"), ("body", "body"), ("none", "tables")])
def test_template_faults(spark, change, fault):
    cells = [(1, 0, r, c, f"{['неделя', 'тема'][r % 2]} {c}" if r < 2 else " ") for r in range(3) for c in range(8)]
    cells += {"tables": [(1, 1, 0, 0, "x")], "columns": [(1, 0, 0, 8, "x")], "rows": [(1, 0, 3, 0, "")], "body": []}.get(change, [])
    cells = [(d, t, r, c, None if change == "markers" and r == 1 else "занято" if change == "body" and r == 2 and c == 5 else x) for d, t, r, c, x in cells]
    df = spark.createDataFrame([] if change == "none" else cells, "doc_id int, table int, row int, col int, text string")
    assert uploads.template_faults(spark.createDataFrame([(1,)], "doc_id int"), df, ["неделя", "тема"]).first()["fault"] == fault
