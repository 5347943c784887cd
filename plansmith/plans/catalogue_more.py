"""More registered queries: numbers and texts of titles, calendars, registries, remarks, uploads and rounds, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as tx
from ..operators import rollups, rounds, sequences
from ..session import table
from ..sources import uploads
from . import registry, remarks
from .catalogue import _GRID, _years, query

_MONTHS = "['января', 'февраля', 'марта', 'апреля', 'мая', 'июня', 'июля', 'августа', 'сентября', 'октября', 'ноября', 'декабря']"
_CAPTION = f"CASE WHEN month(a) = month(b) THEN day(a) || '–' || day(b) || ' ' || {_MONTHS}[month(b)] ELSE day(a) || ' ' || {_MONTHS}[month(a)] || ' — ' || day(b) || ' ' || {_MONTHS}[month(b)] END"


@query("""
    SELECT o_orderkey, CASE WHEN p LIKE '1%' THEN CAST(o_orderkey AS VARCHAR) WHEN p LIKE '5%' THEN CAST(o_custkey AS VARCHAR)
        ELSE o_custkey || '.' || CAST(sum(CASE WHEN p LIKE '1%' OR p LIKE '5%' THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS display_number
    FROM (SELECT *, o_orderpriority AS p FROM orders)
""")
def display_numbers(spark, sf_dir):
    """Numbers for topics that have none."""
    p = F.col("o_orderpriority")
    own = F.when(p.startswith("1"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".")))
    rows = sequences.display_numbers(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.concat(F.col("o_custkey").cast("string"), F.lit(".")), own, p.startswith("5"))
    return rows.select("o_orderkey", "display_number")


@query(r"""
    WITH c AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM benchmark),
    s AS (SELECT item_id, x, list_filter(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda p: p <> '') AS parts FROM c)
    SELECT item_id, CAST(len(parts) AS INTEGER) AS n_sentences, array_to_string(list_filter(list_transform(parts, lambda p: regexp_replace(trim(p), '\.+$', '')), lambda p: p <> ''), '. ') AS joined,
           upper(x[1]) || x[2:] || CASE WHEN right(x, 1) IN ('.', '!', '?') THEN '' ELSE '.' END AS capped FROM s
""")
def sentence_texts(spark, sf_dir):
    """Sentences, joined again, and a text as one sentence."""
    parts = tx.sentences(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(parts).alias("n_sentences"), tx.joined_sentences(parts).alias("joined"), tx.cap_sentence(F.col("text")).alias("capped"))


_TITLED = "(SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '.' || (p_partkey % 7) || '.  ' || p_name WHEN 1 THEN p_size || '.' || p_name ELSE p_name END AS x FROM part)"


@query(rf"""
    SELECT p_partkey, nullif(regexp_extract(x, '^(\d+(?:\.\d+)*)\.?\s*\S', 1), '') AS plan_number, trim(regexp_replace(regexp_replace(x, '^\d+(?:\.\d+)*\.?\s*', ''), '\s+', ' ', 'g')) AS plan_title,
           nullif(regexp_extract(x, '^(\d+(?:\.\d+)*)\.?\s+.', 1), '') AS programme_number, trim(regexp_replace(regexp_replace(x, '^\d+(?:\.\d+)*\.?\s+', ''), '\s+', ' ', 'g')) AS programme_title FROM {_TITLED}
""")
def number_titles(spark, sf_dir):
    """Numbers and titles as plans and as programmes write them."""
    key = F.col("p_partkey")
    size, name = F.col("p_size").cast("string"), F.col("p_name")
    x = F.when(key % 3 == 0, F.concat(size, F.lit("."), (key % 7).cast("string"), F.lit(".  "), name)).when(key % 3 == 1, F.concat(size, F.lit("."), name)).otherwise(name)
    pairs = [*zip(("plan_number", "plan_title"), tx.number_and_title(x)), *zip(("programme_number", "programme_title"), tx.programme_number_and_title(x))]  # noqa: B905
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in pairs])


_MARKED = """(SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text || chr(10) || 'Практика. ' || role WHEN 1 THEN text || ' практика. ' || role || chr(10) || ' Практические занятия ' || role
    WHEN 2 THEN text || chr(10) || 'Практические занятия. ' || role || ' Практика. x' ELSE text END AS x FROM conversations)"""


@query(rf"""
    WITH m AS (SELECT conv_id, turn, x, regexp_replace(x, '(?i)(?:^|\n)\s*(?:Практика\.|Практические занятия\.?)\s*', chr(1)) AS cut, instr(regexp_replace(x, '(?i)(?:^|\n)\s*Практические занятия\.?\s*', chr(1)), chr(1)) AS block, instr(lower(x), 'практика.') AS split FROM {_MARKED})
    SELECT conv_id, turn, CASE WHEN cut <> x THEN regexp_replace(split_part(cut, chr(1), 1), '^\s+|\s+$', '', 'g') END AS theory, CASE WHEN cut <> x THEN regexp_replace(split_part(cut, chr(1), 2), '^\s+|\s+$', '', 'g') END AS practice,
           CASE WHEN block = 0 AND split = 0 THEN NULL WHEN split = 0 OR (block > 0 AND block <= split) THEN 'block' ELSE 'split' END AS marker FROM m
""")
def practice_markers(spark, sf_dir):
    """Texts parted at practice markers."""
    turn, text, role = F.col("turn"), F.col("text"), F.col("role")
    x = F.when(turn % 4 == 0, F.concat(text, F.lit("\nПрактика. "), role)).when(turn % 4 == 1, F.concat(text, F.lit(" практика. "), role, F.lit("\n Практические занятия "), role))
    x = x.when(turn % 4 == 2, F.concat(text, F.lit("\nПрактические занятия. "), role, F.lit(" Практика. x"))).otherwise(text)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", x.alias("x"))
    theory, practice = tx.split_explicit_practice(F.col("x"))
    return rows.select("conv_id", "turn", theory.alias("theory"), practice.alias("practice"), tx.practice_marker(F.col("x")).alias("marker"))


@query("""
    SELECT p_partkey, CASE WHEN h % 10 = 1 AND h % 100 <> 11 THEN 'час' WHEN h % 10 IN (2, 3, 4) AND h % 100 NOT IN (12, 13, 14) THEN 'часа' ELSE 'часов' END AS hours, CASE WHEN h = 1 THEN 'час' WHEN h IN (2, 3, 4) THEN 'часа' ELSE 'часов' END AS short_hours,
           CASE WHEN h % 10 = 1 AND h % 100 <> 11 THEN 'неделя' WHEN h % 10 IN (2, 3, 4) AND h % 100 NOT IN (12, 13, 14) THEN 'недели' ELSE 'недель' END AS weeks FROM (SELECT p_partkey, p_partkey % 130 AS h FROM part)
""")
def counted_words(spark, sf_dir):
    """Plural forms of hours, in both versions, and weeks."""
    h = F.col("p_partkey") % 130
    return table(spark, sf_dir, "part").select("p_partkey", tx.hours_word(h).alias("hours"), tx.short_hours_word(h).alias("short_hours"), tx.counted_word(h, tx.WEEKS).alias("weeks"))


@query(r"""
    SELECT p_partkey, 'Календарный_план_' || CASE WHEN s = '' THEN 'календарь' ELSE s END || '_2026-2027.docx' AS file_name
    FROM (SELECT p_partkey, trim(regexp_replace(x, '[<>:"/\\|?*\s]+', '_', 'g'), '_') AS s FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name || ' "a/b" *' WHEN 1 THEN '?? **' WHEN 2 THEN 'программа' ELSE p_name END AS x FROM part))
""")
def output_file_names(spark, sf_dir):
    """File names from programme names."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.concat("p_name", F.lit(' "a/b" *'))).when(k == 1, "?? **").when(k == 2, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.output_filename(name, F.lit("2026–2027")).alias("file_name"))


@query(f"""
    SELECT o_orderkey, {_CAPTION} AS week_caption, CASE WHEN year(a) <> year(b) THEN day(a) || ' ' || {_MONTHS}[month(a)] || ' ' || year(a) || ' — ' || day(b) || ' ' || {_MONTHS}[month(b)] || ' ' || year(b) ELSE {_CAPTION} || ' ' || year(b) END AS break_caption,
           CASE WHEN month(a) <> 8 THEN CAST(date_trunc('month', a) + INTERVAL 1 MONTH AS DATE) END AS next_month, CASE WHEN month(a) <> 9 THEN CAST(date_trunc('month', a) - INTERVAL 1 MONTH AS DATE) END AS previous_month
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS b FROM orders)
""")
def date_captions(spark, sf_dir):
    """Days in words and neighbouring months of the academic year."""
    a = F.to_date("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), F.date_add(a, (F.col("o_orderkey") % 40).cast("int")).alias("b"))
    return rows.select("o_orderkey", cal.week_caption(F.col("a"), F.col("b")).alias("week_caption"), cal.break_caption(F.col("a"), F.col("b")).alias("break_caption"), cal.adjacent_month(F.col("a"), 1).alias("next_month"), cal.adjacent_month(F.col("a"), -1).alias("previous_month"))


@query(f"""
    SELECT start_year, coalesce(string_agg('№' || week || ' — ' || {_CAPTION}, '; ' ORDER BY week) FILTER (WHERE b - a < 6), '') AS short_weeks FROM (SELECT start_year, week, start_day AS a, end_day AS b FROM ({_GRID})) GROUP BY start_year
""")
def short_week_list(spark, sf_dir):
    """Each year's short weeks in one text."""
    line = F.concat(F.lit("№"), F.col("week").cast("string"), F.lit(" — "), cal.week_caption(F.col("start_day"), F.col("end_day")))
    short = F.when(F.datediff("end_day", "start_day") < 6, F.struct("week", line.alias("line")))
    return cal.week_grid(_years(spark, sf_dir)).groupBy("start_year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(short)), lambda s: s["line"]), "; ").alias("short_weeks"))


_BREAKS = ", ".join(f"(DATE '{a}', DATE '{b}', {str(only).lower()})" for _, a, b, only in registry.BREAKS)
_SPECIAL = ", ".join(f"(DATE '{d}', '{kind}')" for kind, days in (("holiday", registry.HOLIDAYS), ("professional", registry.PROFESSIONAL)) for d in days)


@query(f"""
    WITH classes AS (SELECT DISTINCT ['1 класс', '1А', '5Б'][1 + n_nationkey % 3] AS class_name FROM nation),
    grid AS (SELECT start_day, end_day FROM ({_GRID.replace("SELECT DISTINCT CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END AS INTEGER) AS start_year FROM orders", "SELECT 2026 AS start_year")})),
    days AS (SELECT CAST(unnest(generate_series(DATE '2026-09-01', DATE '2027-08-31', INTERVAL 1 DAY)) AS DATE) AS day),
    marked AS (SELECT day, class_name, (SELECT min(end_day - start_day) FROM grid WHERE day BETWEEN start_day AND end_day) AS len, s.kind AS special,
        EXISTS (SELECT 1 FROM (VALUES {_BREAKS}) b(x, y, only_first) WHERE day BETWEEN x AND y AND (NOT only_first OR class_name <> '5Б')) AS recommended
        FROM days CROSS JOIN classes LEFT JOIN (VALUES {_SPECIAL}) s(d, kind) ON d = day),
    kinds AS (SELECT class_name, coalesce(len < 6, false) AS short_week, CASE WHEN special IS NOT NULL THEN special
        WHEN (recommended OR (len IS NULL AND day < (SELECT max(end_day) FROM grid))) AND isodow(day) >= 6 THEN 'break weekend' WHEN recommended OR (len IS NULL AND day < (SELECT max(end_day) FROM grid)) THEN 'break'
        WHEN isodow(day) >= 6 THEN 'weekend' WHEN len IS NOT NULL THEN 'study' ELSE 'none' END AS kind FROM marked)
    SELECT class_name, kind, short_week, count(*) AS n_days FROM kinds GROUP BY ALL
""")
def break_calendar(spark, sf_dir):
    """Kinds of days of the approved year for each class: grid, gaps, breaks, holidays."""
    names = F.array(*[F.lit(c) for c in ("1 класс", "1А", "5Б")])
    classes = table(spark, sf_dir, "nation").select(F.get(names, (F.col("n_nationkey") % 3).cast("int")).alias("class_name"))
    return registry.year_days(spark, classes).groupBy("class_name", "kind", "short_week").agg(F.count("*").alias("n_days"))


_DOCUMENTS = """(SELECT CAST(s_nationkey % 3 AS INTEGER) AS version, CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE CAST(s_suppkey AS VARCHAR) END AS number, CASE WHEN s_suppkey % 11 <> 0 THEN s_name END AS title, CASE WHEN s_suppkey % 5 = 0 THEN 'http://x' ELSE 'https://x' END AS official_url,
    DATE '2020-01-01' + CAST(s_suppkey % 50 AS INTEGER) AS document_date, DATE '2020-06-01' AS effective_from, CASE WHEN s_suppkey % 4 <> 0 THEN DATE '2020-05-20' + CAST(s_suppkey % 30 AS INTEGER) END AS effective_until, DATE '2020-01-20' AS verified_on FROM supplier)"""


def _documents(spark, sf_dir):
    k = F.col("s_suppkey")
    day = lambda d, m: F.date_add(F.lit(d).cast("date"), (k % m).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        (F.col("s_nationkey") % 3).cast("int").alias("version"), F.when(k % 7 == 0, " ").otherwise(k.cast("string")).alias("number"), F.when(k % 11 != 0, F.col("s_name")).alias("title"), F.when(k % 5 == 0, "http://x").otherwise("https://x").alias("official_url"),
        day("2020-01-01", 50).alias("document_date"), F.lit("2020-06-01").cast("date").alias("effective_from"), F.when(k % 4 != 0, day("2020-05-20", 30)).alias("effective_until"), F.lit("2020-01-20").cast("date").alias("verified_on"),
    )


@query(f"""
    SELECT version, number, unnest(list_filter([CASE WHEN trim(number) = '' THEN 'blank_number' END, CASE WHEN title IS NULL THEN 'blank_title' END, CASE WHEN official_url NOT LIKE 'https://%' THEN 'address' END,
        CASE WHEN effective_until < effective_from THEN 'validity' END, CASE WHEN verified_on < document_date THEN 'verified_too_early' END], lambda r: r IS NOT NULL)) AS rule FROM {_DOCUMENTS}
""")
def registry_rules(spark, sf_dir):
    """Rules that registered documents break."""
    return registry.registry_faults(_documents(spark, sf_dir))


@query(f"SELECT version, number FROM {_DOCUMENTS} WHERE version = (SELECT max(version) FROM {_DOCUMENTS})")
def registry_latest(spark, sf_dir):
    """Documents of the registry's latest version."""
    return registry.latest_version(_documents(spark, sf_dir)).select("version", "number")


_CHECKS = """(SELECT o_orderkey, c.check_id, ['pass', 'warning', 'not_checked'][1 + (o_orderkey // c.step) % 3] AS verdict FROM orders, (VALUES ('study_year_found', 1), ('year_within_duration', 3), ('duration_found', 9), ('short_week_full_load', 2), ('topic_hours', 5)) c(check_id, step))"""


@query(f"""
    WITH c AS {_CHECKS}, h AS (SELECT o_orderkey FROM c GROUP BY o_orderkey HAVING count(*) FILTER (WHERE (check_id = 'study_year_found' AND verdict = 'pass') OR (check_id = 'year_within_duration' AND verdict = 'not_checked')) = 2)
    SELECT o_orderkey, check_id, verdict FROM c WHERE verdict <> 'pass' AND NOT (check_id = 'short_week_full_load' AND verdict = 'warning') AND NOT (check_id = 'duration_found' AND verdict = 'warning' AND o_orderkey IN (SELECT o_orderkey FROM h))
""")
def visible_remarks(spark, sf_dir):
    """Remarks that are shown (P25)."""
    steps = {"study_year_found": 1, "year_within_duration": 3, "duration_found": 9, "short_week_full_load": 2, "topic_hours": 5}
    verdicts = F.array(*[F.lit(v) for v in ("pass", "warning", "not_checked")])
    checks = F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.get(verdicts, (F.floor(F.col("o_orderkey") / F.lit(s)) % 3).cast("int")).alias("verdict")) for k, s in steps.items()]))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", checks.alias("c")).select("o_orderkey", "c.*")
    return remarks.visible_remarks(rows, ["o_orderkey"])


@query(f"""
    SELECT event_id, array_to_string(list_filter([CASE WHEN event_type <> 'click' THEN event_type END, CASE WHEN event_id % 3 = 0 THEN 'x' END, CASE WHEN event_id % 2 = 0 THEN '{remarks.SAFE_MESSAGE}' END], lambda w: w IS NOT NULL), '|') AS shown FROM events
""")
def reader_warnings(spark, sf_dir):
    """Warnings as a reader sees them."""
    k = F.col("event_id")
    safe = F.when(k % 2 == 0, F.lit("Безопасный шаблон CE2: broken_clause_join."))
    warnings = F.array_compact(F.array(safe, F.col("event_type"), F.when(k % 3 == 0, "x"), F.when(k % 4 == 0, F.lit("Безопасный шаблон CE2: empty_triad."))))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(remarks.reader_warnings(warnings, ["click"]), "|").alias("shown"))


@query("""
    SELECT o_orderkey, round, CASE WHEN round IS NOT NULL THEN o_orderkey * 10 + round END AS answer
    FROM (SELECT o_orderkey, CAST(CASE WHEN (o_orderkey + 1) % 4 = 0 THEN 1 WHEN (o_orderkey * 2 + 2) % 4 = 0 THEN 2 WHEN (o_orderkey * 3 + 3) % 4 = 0 THEN 3 WHEN (o_orderkey * 4 + 4) % 5 = 0 THEN 4 END AS INTEGER) AS round FROM orders)
""")
def answer_rounds(spark, sf_dir):
    """Rounds over open requests, and what stays open."""

    def attempt(left, i):
        k = F.col("o_orderkey")
        return left.where((k * i + i) % (5 if i == 4 else 4) == 0).withColumn("answer", k * 10 + i)

    answers, left = rounds.retry_rounds(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], attempt)
    return answers.select("o_orderkey", "round", "answer").unionByName(left, allowMissingColumns=True)


@query("""
    WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS l_orderkey, CASE WHEN b.k IS NULL THEN 'ours' WHEN a.k IS NULL THEN 'theirs' ELSE 'both' END AS side, coalesce(a.n = b.n, false) AS equal FROM a FULL JOIN b ON a.k = b.k
""")
def compared_rows(spark, sf_dir):
    """Two versions of rows side by side."""
    lines = table(spark, sf_dir, "lineitem")
    ours = lines.where("l_orderkey % 3 != 0").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    theirs = lines.where("l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n"))
    return rounds.compared(ours, theirs, ["l_orderkey"], ["n"])


@query("SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) = 1 AS shared FROM lineitem GROUP BY l_orderkey")
def shared_contexts(spark, sf_dir):
    """Whether all requests of a batch share one context."""
    return rounds.shared_context(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query("SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS phrases FROM (SELECT conv_id, role, min(turn) AS turn FROM conversations WHERE trim(role) <> '' GROUP BY ALL) GROUP BY conv_id")
def phrases_to_avoid(spark, sf_dir):
    """Accepted phrases of a topic, in order."""
    rows = rounds.accepted_phrases(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    return rows.select("conv_id", F.array_join("phrases", "|").alias("phrases"))


@query("""
    SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS n_rows, CAST(CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN 2 * k WHEN 2 THEN k END AS BIGINT) AS total
    FROM (SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events)
""")
def lenient_json(spark, sf_dir):
    """Answers in fences, alone, or cut off."""
    k, props = F.col("event_id") % 4, F.col("props")
    raw = F.when(k == 0, F.concat(F.lit("```json\n["), props, F.lit("]\n```"))).when(k == 1, F.concat(F.lit("["), props, F.lit(","), props, F.lit(', {"k": 1'))).when(k == 2, props).otherwise("none")
    rows = table(spark, sf_dir, "events").select("event_id", rounds.json_rows(raw, "struct<k: int>").alias("rows"))
    return rows.select("event_id", F.size("rows").alias("n_rows"), F.when(F.size("rows") > 0, F.aggregate("rows", F.lit(0).cast("long"), lambda t, r: t + r["k"])).alias("total"))


@query("""
    SELECT c_custkey, CAST(m AS INTEGER) AS month, count(o_orderkey) AS n_orders, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 0) AS total
    FROM customer CROSS JOIN range(1, 13) r(m) LEFT JOIN orders ON o_custkey = c_custkey AND month(o_orderdate) = m GROUP BY ALL
""")
def loads_with_empty_bins(spark, sf_dir):
    """Loads of all bins, empty ones too."""
    bins = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return rollups.filled_bins(bins, orders, ["c_custkey", "month"], {"n_orders": F.count("*"), "total": F.sum("price").cast("double")})


@query("""
    SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN opened AND NOT heading AND turn % 4 = 3 THEN 1 ELSE 0 END) OVER w AS ended FROM (
        SELECT conv_id, turn, turn % 4 = 1 AS heading, max(CASE WHEN turn % 4 = 1 THEN 1 ELSE 0 END) OVER w = 1 AS opened FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE opened AND NOT heading AND ended = 0
""")
def captured_lines(spark, sf_dir):
    """Rows after a heading up to the first stop."""
    rows = sequences.captured_after(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("turn") % 4 == 1, F.col("turn") % 4 == 3)
    return rows.where("captured").select("conv_id", "turn")


@query("SELECT d.doc_id, CAST(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 2 END AS INTEGER) AS source, CAST(coalesce(l.quality, d.n_chars) AS BIGINT) AS value FROM documents d LEFT JOIN (SELECT * FROM labels WHERE quality = 1) l USING (doc_id)")
def preferred_sources(spark, sf_dir):
    """The first of two sources that has a key."""
    first = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.col("quality").cast("long").alias("value"))
    return uploads.preferred_source([first, table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("value"))], ["doc_id"])


@query("""
    SELECT user_id, event_id, level FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level, ts, event_id) AS r FROM (SELECT *, CAST(CASE WHEN event_id % 50 = 0 THEN 1 WHEN event_id % 9 = 0 THEN 2 WHEN event_id % 2 = 0 THEN 3 END AS INTEGER) AS level FROM events) WHERE level IS NOT NULL) WHERE r = 1
""")
def preferred_headings(spark, sf_dir):
    """The first row of the best of three levels."""
    k = F.col("event_id")
    return uploads.by_preference(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], [k % 50 == 0, k % 9 == 0, k % 2 == 0]).select("user_id", "event_id", "level")


@query("""
    SELECT page_id, CASE WHEN page_id % 5 = 2 THEN 'extension' WHEN page_id % 3 = 1 THEN 'empty' WHEN 4 + strlen(html) > 600 THEN 'size' WHEN page_id % 3 = 2 OR page_id % 5 = 1 THEN 'content' END AS fault FROM pages
""")
def upload_faults(spark, sf_dir):
    """The first rule that an upload breaks."""
    k = F.col("page_id")
    name = F.when(k % 5 == 2, "plan.pdf").when(k % 5 == 1, "plan.DOC").otherwise("plan.v1.docx")
    start = F.when(k % 3 == 2, F.unhex(F.lit("00000000"))).otherwise(F.unhex(F.lit("504B0304")))
    content = F.when(k % 3 != 1, F.concat(start, F.encode("html", "UTF-8")))
    return table(spark, sf_dir, "pages").select("page_id", uploads.upload_fault(name, content, most=600).alias("fault"))


@query("""
    SELECT item_id, item_id % 3 = 0 AS normative, item_id % 4 = 1 AS calendar_form FROM benchmark
""")
def content_types(spark, sf_dir):
    """Texts of normative documents and calendar forms."""
    k = F.col("item_id")
    x = F.concat("text", F.when(k % 3 == 0, " Федеральный ЗАКОН").otherwise(""), F.when(k % 4 == 1, " Тип занятия, ВИД контроля; планируемый результат").when(k % 4 == 2, " тип занятия, вид контроля").otherwise(""))
    return table(spark, sf_dir, "benchmark").select("item_id", uploads.looks_normative(x).alias("normative"), uploads.looks_like_calendar_form(x).alias("calendar_form"))


@query("SELECT CAST(page_id % 7 AS BIGINT) AS operation, count(*) AS n_files, CAST(sum(strlen(html)) AS BIGINT) AS n_bytes FROM pages GROUP BY 1")
def operation_totals(spark, sf_dir):
    """Files and bytes of each operation."""
    return table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 7).cast("long").alias("operation")).agg(F.count("*").alias("n_files"), F.sum(F.octet_length("html")).cast("long").alias("n_bytes"))
