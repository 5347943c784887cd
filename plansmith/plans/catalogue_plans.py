"""Queries of whole plans: orders as plans whose lines are topics, from positions to weeks, checks and reports; conversations as programmes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import rounds
from ..session import dealt, table
from ..sources import programme, uploads
from ..staging import stage
from . import audit, clauses, registry, schedule
from .catalogue import _GRID, query

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_TOPICS = f"""
    topics AS (SELECT l_orderkey AS doc_id, 10 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS pos, CASE WHEN l_linenumber % 3 <> 0 THEN '1.' || l_linenumber END AS number, 'topic ' || l_linenumber AS title, l_returnflag AS section,
                      CAST(l_quantity % 4 AS INTEGER) AS th, CAST(l_quantity % 3 AS INTEGER) AS pr, CAST(l_quantity % 4 + l_quantity % 3 + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS INTEGER) AS total FROM lineitem),
    totals AS (SELECT doc_id, sum(th) + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS th, sum(pr) AS pr, sum(th) + sum(pr) AS total FROM topics GROUP BY doc_id HAVING doc_id % 11 <> 0),
    parts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, pos, p) AS seq FROM (SELECT doc_id, pos, number, title, section, unnest([0, 1]) AS p, unnest(['theory', 'practice']) AS part_type, unnest([th, pr]) AS amount FROM topics)),
    ends AS (SELECT *, 2 + doc_id % 3 AS load, CAST(sum(amount) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM parts WHERE amount > 0),
    schedule AS (SELECT doc_id, seq, number, title, section, part_type, CAST(w + 1 AS INTEGER) AS week, CAST(least(e, (w + 1) * load) - greatest(e - amount, w * load) AS INTEGER) AS hours FROM (SELECT *, unnest(range((e - amount) // load, (e - 1) // load + 1)) AS w FROM ends))
"""


def _plans(spark, sf_dir):
    """Positions and workload: every order a plan, its lines topics in the sections of their flags."""
    lines = dealt(table(spark, sf_dir, "lineitem"), ["l_orderkey"])
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))
    theory, practice = (F.col("l_quantity") % 4).cast("int"), (F.col("l_quantity") % 3).cast("int")
    total = theory + practice + F.when(F.col("l_partkey") % 50 == 0, 1).otherwise(0)
    hours = lambda a, b, c: F.struct(a.alias("theory"), b.alias("practice"), c.alias("total"))
    number = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("1."), F.col("l_linenumber").cast("string")))
    text = lambda x: F.lit(x).cast("string")
    topics = lines.select(F.col("l_orderkey").alias("doc_id"), (10 + rank).alias("pos"), F.lit("topic").alias("kind"), number.alias("number"), F.concat(F.lit("topic "), F.col("l_linenumber").cast("string")).alias("title"), hours(theory, practice, total).alias("hours"), F.col("l_returnflag").alias("parent_section"))
    sums = {k: F.sum(F.col(f"hours.{k}")).cast("int").alias(k) for k in ("theory", "practice")}
    of_section = topics.groupBy("doc_id", "parent_section").agg(*sums.values())
    at = F.array_position(F.array(*map(F.lit, "ANR")), F.col("parent_section")).cast("int")
    sections = of_section.select("doc_id", at.alias("pos"), F.lit("section").alias("kind"), text(None).alias("number"), F.col("parent_section").alias("title"), hours(F.col("theory"), F.col("practice"), F.col("theory") + F.col("practice")).alias("hours"), text(None).alias("parent_section"))
    of_plan = topics.groupBy("doc_id").agg(*sums.values()).where("doc_id % 11 != 0")
    wrong = F.col("theory") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)
    last = of_plan.select("doc_id", F.lit(99_999).alias("pos"), F.lit("total").alias("kind"), text(None).alias("number"), F.lit("total").alias("title"), hours(wrong, F.col("practice"), F.col("theory") + F.col("practice")).alias("hours"), text(None).alias("parent_section"))
    positions, _ = stage(topics.unionByName(sections).unionByName(last), "positions")  # each check reads them anew
    load = positions.where("kind = 'topic'").select("doc_id").distinct().select("doc_id", F.lit(5).alias("study_weeks"), (2 + F.col("doc_id") % 3).cast("int").alias("hours_per_week"), F.lit(2026).alias("start_year"))
    return positions, load


@query(f"WITH {_TOPICS} SELECT doc_id, CAST(seq AS INTEGER) AS seq, number, title, section, part_type, week, hours FROM schedule")
def plan_schedule(spark, sf_dir):
    """Theory and practice of each plan's topics in weeks, sections in order."""
    return schedule.build_schedule(*_plans(spark, sf_dir))


@query(f"""
    WITH {_TOPICS}, s AS (SELECT doc_id, section, sum(th) AS th, sum(pr) AS pr, sum(total) AS total FROM topics GROUP BY ALL), t AS (SELECT doc_id, sum(th) AS th, sum(pr) AS pr, sum(total) AS total FROM topics GROUP BY ALL),
    f AS (SELECT doc_id, 'topic_hours' AS check_id FROM topics WHERE total <> th + pr UNION ALL SELECT doc_id, 'section_hours' FROM s WHERE total <> th + pr
          UNION ALL SELECT doc_id, 'total_row' FROM totals WHERE total <> th + pr UNION ALL SELECT t.doc_id, 'total_sum' FROM t JOIN totals u ON u.doc_id = t.doc_id WHERE (u.th, u.pr, u.total) <> (t.th, t.pr, t.total)
          UNION ALL SELECT t.doc_id, 'yearly_hours' FROM t JOIN totals u ON u.doc_id = t.doc_id WHERE u.total <> 5 * (2 + t.doc_id % 3))
    SELECT doc_id, check_id, count(*) AS n FROM f GROUP BY ALL
""")
def plan_arithmetic(spark, sf_dir):
    """Arithmetic warnings of each plan, by kind."""
    positions, load = _plans(spark, sf_dir)
    facts = load.select("doc_id", F.lit(None).cast("int").alias("hours_per_year"), "study_weeks", "hours_per_week", F.lit(None).cast("int").alias("stated_schedule_hours"))
    return schedule.validate_plan(positions, facts).groupBy("doc_id", "check_id").agg(F.count("*").alias("n"))


_VALID = f"""
    WITH {_TOPICS}, kept AS (SELECT * FROM schedule WHERE NOT (doc_id % 7 = 0 AND week = 1)),
    sums AS (SELECT doc_id, sum(CASE WHEN part_type = 'theory' THEN hours ELSE 0 END) AS th, sum(CASE WHEN part_type = 'practice' THEN hours ELSE 0 END) AS pr FROM kept GROUP BY doc_id),
    ours AS (SELECT DISTINCT doc_id, number, title, section FROM kept), theirs AS (SELECT DISTINCT doc_id, number, title, section FROM topics),
    diff AS (SELECT DISTINCT doc_id FROM ((SELECT * FROM ours EXCEPT SELECT * FROM theirs) UNION ALL (SELECT * FROM theirs EXCEPT SELECT * FROM ours))),
    plans AS (SELECT DISTINCT doc_id FROM topics),
    loads AS (SELECT doc_id, week, sum(hours) AS h FROM kept GROUP BY ALL), grid AS (SELECT doc_id, CAST(unnest(range(1, 6)) AS INTEGER) AS week FROM plans),
    l AS (SELECT coalesce(g.doc_id, l.doc_id) AS doc_id, bool_or(g.week IS NULL OR coalesce(h, 0) > 2 + coalesce(g.doc_id, l.doc_id) % 3) AS over, bool_or(g.week IS NOT NULL AND coalesce(h, 0) < 2 + g.doc_id % 3) AS under FROM grid g FULL JOIN loads l ON l.doc_id = g.doc_id AND l.week = g.week GROUP BY 1)
"""


@query(f"""{_VALID}
    SELECT p.doc_id, array_to_string(list_filter([CASE WHEN t.doc_id IS NULL THEN 'total_row_missing' END, CASE WHEN (coalesce(s.th, 0), coalesce(s.pr, 0), coalesce(s.th, 0) + coalesce(s.pr, 0)) <> (t.th, t.pr, t.total) AND t.doc_id IS NOT NULL THEN 'hours' END,
           CASE WHEN d.doc_id IS NOT NULL THEN 'positions' END, CASE WHEN l.over THEN 'overload' END, CASE WHEN l.under THEN 'empty_hours' END], lambda x: x IS NOT NULL), ',') AS failed
    FROM plans p LEFT JOIN sums s ON s.doc_id = p.doc_id LEFT JOIN totals t ON t.doc_id = p.doc_id LEFT JOIN diff d ON d.doc_id = p.doc_id LEFT JOIN l ON l.doc_id = p.doc_id
""")
def schedule_checks(spark, sf_dir):
    """What is wrong with each plan's schedule, some of which have lost their first week."""
    positions, load = _plans(spark, sf_dir)
    kept = schedule.build_schedule(positions, load).where("NOT (doc_id % 7 = 0 AND week = 1)")
    return schedule.validate_schedule(kept, positions, load).select("doc_id", F.array_join("failed", ",").alias("failed"))


@query(f"""{_VALID},
    hc AS (SELECT t.doc_id, bool_and(t.total = t.th + t.pr) AS ok, sum(t.th) AS th, sum(t.pr) AS pr FROM topics t GROUP BY 1),
    c AS (
        SELECT h.doc_id, 'topic_hours' AS check_id, h.ok AS v FROM hc h
        UNION ALL SELECT h.doc_id, 'theory_practice_hours', CASE WHEN t.doc_id IS NOT NULL THEN h.th = t.th AND h.pr = t.pr END FROM hc h LEFT JOIN totals t ON t.doc_id = h.doc_id
        UNION ALL SELECT coalesce(t.doc_id, s.doc_id, p.doc_id), 'plan_matches_utp', CASE WHEN t.doc_id IS NOT NULL AND s.doc_id IS NOT NULL THEN s.th = t.th AND s.pr = t.pr AND s.th + s.pr = t.total AND d.doc_id IS NULL END
                  FROM plans p LEFT JOIN totals t ON t.doc_id = p.doc_id LEFT JOIN sums s ON s.doc_id = p.doc_id LEFT JOIN diff d ON d.doc_id = p.doc_id
        UNION ALL SELECT doc_id, 'yearly_hours', CASE WHEN n = 0 THEN NULL ELSE n = 1 END FROM (SELECT p.doc_id, CASE WHEN t.doc_id IS NULL THEN 1 WHEN t.total = 20 THEN 1 ELSE 2 END AS n FROM plans p LEFT JOIN totals t ON t.doc_id = p.doc_id)
        UNION ALL SELECT doc_id, 'weekly_load', CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 4 <> 1 END FROM plans
        UNION ALL SELECT doc_id, 'registry_in_force', true FROM plans
    )
    SELECT doc_id, count(*) FILTER (WHERE v) AS passed, count(*) FILTER (WHERE NOT v) AS warnings, count(*) FILTER (WHERE v IS NULL) AS not_checked, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (WHERE NOT v), '') AS warned FROM c GROUP BY doc_id
""")
def audit_summary(spark, sf_dir):
    """The audit of each plan in one row: hours, topics, workload, regulations in force."""
    positions, load = _plans(spark, sf_dir)
    kept = schedule.build_schedule(positions, load).where("NOT (doc_id % 7 = 0 AND week = 1)")
    totals = positions.where("kind = 'total'").select("doc_id", F.col("hours.total").alias("total_hours"))
    k = F.col("doc_id") % 4
    facts = load.select("doc_id", F.lit(20).alias("hours_per_year"), F.lit(None).cast("int").alias("stated_schedule_hours"), F.when(k == 1, "derived").when(k > 1, "document").alias("provenance")).join(totals, "doc_id", "left")
    rows = audit.report(audit.hour_checks(positions), audit.plan_checks(positions, kept), audit.workload_checks(facts), audit.registry_checks(load, [(None, None)]))
    out = audit.summary(rows)
    return out.select("doc_id", "passed", "warnings", "not_checked", F.array_join("warned", ",").alias("warned"))


@query(f"""
    WITH g AS (SELECT start_day, end_day FROM ({_GRID}) WHERE start_year = 2026), plans AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 2025 ELSE 2026 END AS y FROM customer)
    SELECT doc_id, 'academic_grid' AS check_id, CASE WHEN doc_id % 7 = 6 THEN 'not_checked' WHEN y = 2026 AND doc_id % 7 NOT IN (0, 1) THEN 'pass' ELSE 'warning' END AS verdict FROM plans
""".replace("WITH g AS (SELECT start_day, end_day FROM (" + _GRID + ") WHERE start_year = 2026), ", "WITH "))
def grid_verdicts(spark, sf_dir):
    """Each customer's weeks against the approved grid: some lack a week, some have one twice, some have none (P20)."""
    year = F.when(F.col("c_custkey") % 5 == 0, 2025).otherwise(2026)
    plans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), year.alias("start_year"))
    grid = cal.week_grid(spark.createDataFrame([(2026,)], "start_year int")).select("week", "start_day", "end_day")
    k = F.col("doc_id") % 7
    weeks = plans.where(k != 6).crossJoin(F.broadcast(grid)).where((k != 0) | (F.col("week") != 9))  # 36 rows a plan
    twice = weeks.where((k == 1) & (F.col("week") == 4))
    return audit.grid_checks(weeks.unionByName(twice).select("doc_id", "start_day", "end_day"), plans)


_SAID = ["Цель программы: ", "Задачи: ", "Планируемые результаты", "Знать:", "Уметь", "Срок реализации: 2 года"]
_PARAGRAPHS = """
    SELECT conv_id AS doc_id, turn * 100000 + ln AS pos, trim(regexp_replace(CASE ln WHEN 0 THEN CASE turn % 6 WHEN 0 THEN 'Цель программы: ' || line WHEN 1 THEN 'Задачи: ' || line WHEN 2 THEN 'Планируемые результаты' WHEN 3 THEN 'Знать:' WHEN 4 THEN 'Уметь' ELSE 'Срок реализации: 2 года' END ELSE '• ' || line END, '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS text,
           CASE WHEN ln = 0 THEN turn % 6 END AS head FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM conversations)
"""
_ITEMS = "string_agg(item, '|' ORDER BY pos)"


@query(rf"""
    WITH p AS ({_PARAGRAPHS}), q AS (SELECT * FROM p WHERE text <> ''),
    w AS (SELECT *, max(CASE WHEN head = 1 THEN 1 ELSE 0 END) OVER r = 1 AS open1, max(CASE WHEN head = 2 THEN 1 ELSE 0 END) OVER r = 1 AS open2, last_value(CASE head WHEN 2 THEN 'none' WHEN 3 THEN 'knowledge' WHEN 4 THEN 'skills' END IGNORE NULLS) OVER r AS kind FROM q WINDOW r AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT *, max(CASE WHEN open1 AND head IN (0, 2, 5) THEN 1 ELSE 0 END) OVER r = 1 AS end1 FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    bare AS (SELECT *, trim(regexp_replace(text, '^[•–—-][ ]*', '')) AS b FROM e),
    tasks AS (SELECT doc_id, pos, CASE WHEN head = 1 THEN trim(substr(text, 9)) ELSE b END AS item FROM bare WHERE open1 AND NOT end1),
    said AS (SELECT doc_id, kind, pos, unnest(parts) AS item, generate_subscripts(parts, 1) AS i FROM (
        SELECT doc_id, kind, pos, list_filter(list_transform(string_split(regexp_replace(regexp_replace(b, '^[ ;.]+', ''), '[ ;.]+$', ''), ';'), lambda x: regexp_replace(regexp_replace(trim(x), '^[ ;.]+', ''), '[ ;.]+$', '')), lambda x: x <> '') AS parts
        FROM bare WHERE open2 AND kind IN ('knowledge', 'skills') AND (head IS NULL OR head NOT IN (2, 3, 4)))),
    first AS (SELECT doc_id, kind, item, min(pos * 1000 + i) AS place FROM said GROUP BY ALL)
    SELECT d.doc_id, (SELECT trim(substr(text, 17)) FROM q WHERE q.doc_id = d.doc_id AND head = 0 AND trim(substr(text, 17)) <> '' ORDER BY pos LIMIT 1) AS goal, CASE WHEN EXISTS (SELECT 1 FROM q WHERE q.doc_id = d.doc_id AND head = 5) THEN 2 END AS duration_years,
           coalesce((SELECT string_agg(item, '|' ORDER BY pos) FROM tasks WHERE tasks.doc_id = d.doc_id AND item <> ''), '') AS tasks,
           coalesce((SELECT string_agg(item, '|' ORDER BY place) FROM first WHERE first.doc_id = d.doc_id AND kind = 'knowledge'), '') AS knowledge, coalesce((SELECT string_agg(item, '|' ORDER BY place) FROM first WHERE first.doc_id = d.doc_id AND kind = 'skills'), '') AS skills
    FROM (SELECT DISTINCT doc_id FROM q) d
""")
def programme_scan(spark, sf_dir):
    """Conversations as programmes: goal, duration, tasks up to a stop, and outcomes by their labels."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    k = F.col("turn") % 6
    head = F.when(k == 0, F.concat(F.lit(_SAID[0]), "line")).when(k == 1, F.concat(F.lit(_SAID[1]), "line")).when(k == 2, _SAID[2]).when(k == 3, _SAID[3]).when(k == 4, _SAID[4]).otherwise(_SAID[5])
    text = F.when(F.col("ln") == 0, head).otherwise(F.concat(F.lit("• "), "line"))
    paragraphs = rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 100_000 + F.col("ln")).alias("pos"), text.alias("text"), F.lit(False).alias("is_bold"), F.lit(None).cast("string").alias("alignment"))
    out = programme.programmes(paragraphs)
    return out.select("doc_id", "goal", "duration_years", *[F.array_join(c, "|").alias(n) for c, n in (("tasks", "tasks"), ("knowledge_outcomes", "knowledge"), ("skill_outcomes", "skills"))])


@query("""
    SELECT o_orderkey, o_custkey, n_lines, CAST(total AS DOUBLE) AS total FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
def matched_orders(spark, sf_dir):
    """Orders with their lines' totals, each of which must find the other."""
    totals = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(totals.select("o_orderkey"), "o_orderkey", "left_semi")
    return rounds.matched_rows(orders, totals, ["o_orderkey"])


@query("""
    WITH d AS (SELECT l_orderkey AS number, CASE WHEN l_partkey % 40 = 0 THEN NULL ELSE CAST(l_linenumber AS INTEGER) END AS version, CAST(l_shipdate AS DATE) AS effective_from FROM lineitem),
    w AS (SELECT *, count(*) OVER (PARTITION BY number, version) AS n, max(effective_from) OVER (PARTITION BY number ORDER BY version RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM d)
    SELECT number, version, 'no_version' AS rule FROM w WHERE version IS NULL UNION ALL SELECT number, version, 'repeated_version' FROM w WHERE version IS NOT NULL AND n > 1 UNION ALL SELECT number, version, 'order' FROM w WHERE version IS NOT NULL AND effective_from < latest
""")
def version_history(spark, sf_dir):
    """Orders as documents with lines as versions: repeated versions and such as are in force before a lower one."""
    version = F.when(F.col("l_partkey") % 40 != 0, F.col("l_linenumber").cast("int"))
    return registry.history_faults(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("number"), version.alias("version"), F.to_date("l_shipdate").alias("effective_from")))


@query("""
    SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS i, a[i] AS word, b[i] AS line, CASE lower(a[i]) WHEN 'user' THEN 'asks' WHEN 'assistant' THEN 'answers' END AS verb
    FROM (SELECT conv_id, turn, [role, 'x', upper(role)] AS a, string_split(text, chr(10)) AS b, unnest(range(1, greatest(3, len(string_split(text, chr(10)))) + 1)) AS i FROM conversations)
""")
def zipped_lookups(spark, sf_dir):
    """Two lists of a row put side by side, and words looked up in a small table."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(rounds.zipped(F.array("role", F.lit("x"), F.upper("role")), F.split("text", "\n"))).alias("i", "p"))
    return rows.select("conv_id", "turn", "i", F.col("p.a").alias("word"), F.col("p.b").alias("line"), clauses.looked_up(F.col("p.a"), {"user": "asks", "assistant": "answers"}).alias("verb"))


@query("""
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'docx' WHEN page_id % 4 = 1 THEN 'doc' END AS reader FROM pages
""")
def programme_readers(spark, sf_dir):
    """Which reader each file needs by its name."""
    name = F.concat("url", F.get(F.array(*map(F.lit, (".DOCX", ".doc", ".pdf", ".docx.txt"))), (F.col("page_id") % 4).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", uploads.programme_reader(name).alias("reader"))
