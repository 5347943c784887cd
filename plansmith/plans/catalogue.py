"""The registered queries over the driver's tables and their SQL for DuckDB.

Each query applies operators of this library to whole tables; the SQL says the same in another engine's words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as tx
from ..operators import allocation, matching, rollups, sequences
from ..session import table
from ..staging import number_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
_EVENT_ORDER = ["ts", "event_id"]


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ALLOCATED = """
    SELECT l_orderkey, l_linenumber, l_partkey, b + 1 AS week, least(e, (b + 1) * 20) - greatest(e - amount, b * 20) AS hours
    FROM (SELECT *, unnest(range((e - amount) // 20, (e - 1) // 20 + 1)) AS b FROM (
        SELECT *, CAST(sum(amount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
        FROM (SELECT *, CAST(l_quantity AS BIGINT) AS amount FROM lineitem) WHERE amount > 0))
"""


def _allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_ORDER, F.col("l_quantity").cast("long").alias("amount"))
    return allocation.allocate(lines, ["l_orderkey"], _LINE_ORDER, "amount", 20)


@query(_ALLOCATED)
def capacity_allocation(spark, sf_dir):
    """Quantities of each order into bins of 20, split where a bin ends."""
    return _allocated(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "week", "hours")


@query(f"""
    SELECT l_orderkey, week, CAST(sum(hours) AS BIGINT) AS load,
           CASE WHEN sum(hours) > 20 THEN 'over' WHEN sum(hours) < 20 THEN 'under' ELSE 'full' END AS state
    FROM ({_ALLOCATED}) GROUP BY l_orderkey, week
""")
def allocation_load_check(spark, sf_dir):
    """Load of each bin against its capacity."""
    return allocation.load_check(_allocated(spark, sf_dir), ["l_orderkey"], 20)


_GRID = """
    SELECT start_year, week, start_day, CASE WHEN week = 1 THEN first_end WHEN start_year = 2026 AND week = 18 THEN DATE '2026-12-30' ELSE start_day + 6 END AS end_day FROM (
        SELECT *, CASE WHEN week = 1 THEN first_day WHEN start_year = 2026 AND week > 18 THEN DATE '2027-01-11' + CAST((week - 19) * 7 AS INTEGER) ELSE first_end + CAST((week - 2) * 7 + 1 AS INTEGER) END AS start_day
        FROM (SELECT *, first_day + CAST(7 - isodow(first_day) AS INTEGER) AS first_end FROM (
            SELECT start_year, unnest(range(1, 37)) AS week, make_date(start_year, 9, 1) AS first_day
            FROM (SELECT DISTINCT CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END AS INTEGER) AS start_year FROM orders))))
"""


def _years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(cal.start_year_of(F.col("o_orderdate")).alias("start_year")).distinct()


@query(f"""
    SELECT start_year, week, start_day, end_day,
           CASE WHEN month(start_day) = month(end_day) THEN strftime(start_day, '%d') || '–' || strftime(end_day, '%d.%m') ELSE strftime(start_day, '%d.%m') || '–' || strftime(end_day, '%d.%m') END AS date_range
    FROM ({_GRID})
""")
def academic_week_grid(spark, sf_dir):
    """36 weeks of each academic year."""
    return cal.week_grid(_years(spark, sf_dir)).drop("month_label")


@query(f"""
    SELECT g.start_year, g.week, count(*) AS n_orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS DOUBLE) AS total
    FROM ({_GRID}) g JOIN orders o ON CAST(o_orderdate AS DATE) BETWEEN g.start_day AND g.end_day GROUP BY ALL
""")
def week_bucket_orders(spark, sf_dir):
    """Orders by the week that holds their day (J11, A2): weeks are spread to days, so the range join is an equi join."""
    days = cal.week_grid(_years(spark, sf_dir)).select("start_year", "week", F.explode(F.sequence("start_day", "end_day")).alias("day"))
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return orders.join(F.broadcast(days), "day").groupBy("start_year", "week").agg(F.count("*").alias("n_orders"), F.sum("price").cast("double").alias("total"))


@query("""
    SELECT l_returnflag, l_linestatus, CAST(round(l_discount * 100) AS INTEGER) AS discount_percent, count(*) AS n_rows,
           count(*) FILTER (WHERE CAST(l_extendedprice AS DECIMAL(18, 2)) < CAST(l_quantity AS DECIMAL(18, 2)) * 1000) AS n_low,
           count(*) FILTER (WHERE l_quantity <> floor(l_quantity)) AS n_not_whole
    FROM lineitem GROUP BY ALL
""")
def row_arithmetic_check(spark, sf_dir):
    """Rows whose numbers disagree with their own parts."""
    low = F.col("l_extendedprice").cast("decimal(18,2)") < F.col("l_quantity").cast("decimal(18,2)") * 1000
    rows = table(spark, sf_dir, "lineitem").withColumn("discount_percent", F.round(F.col("l_discount") * 100).cast("int"))
    return rows.groupBy("l_returnflag", "l_linestatus", "discount_percent").agg(F.count("*").alias("n_rows"), F.count_if(low).alias("n_low"), F.count_if(F.col("l_quantity") != F.floor("l_quantity")).alias("n_not_whole"))


@query("""
    SELECT o_orderkey, any_value(o_totalprice) AS declared_total, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS children_total, count(*) AS n_children,
           CASE WHEN CAST(any_value(o_totalprice) AS DECIMAL(18, 2)) = sum(CAST(l_extendedprice AS DECIMAL(18, 2))) THEN 'pass' ELSE 'warning' END AS verdict
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def parent_child_rollup(spark, sf_dir):
    """Declared order totals against their lines."""
    lines = table(spark, sf_dir, "lineitem")
    out = rollups.totals_check(table(spark, sf_dir, "orders"), lines, "o_orderkey", "l_orderkey", "o_totalprice", F.col("l_extendedprice").cast("decimal(18,2)"))
    same = F.col("declared_total").cast("decimal(18,2)") == F.col("children_total")
    return out.select("o_orderkey", "declared_total", F.col("children_total").cast("double").alias("children_total"), "n_children", F.when(same, "pass").otherwise("warning").alias("verdict"))


@query("""
    SELECT n_regionkey, n_nationkey, o_orderstatus, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey, o_orderstatus)
""")
def three_level_rollup(spark, sf_dir):
    """Sums at each level of a hierarchy."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("n_regionkey", "n_nationkey", "o_orderstatus").agg(F.count("*").alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
    SELECT l_orderkey, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'A'), 0) AS BIGINT) AS "A",
           CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'N'), 0) AS BIGINT) AS "N",
           CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'R'), 0) AS BIGINT) AS "R"
    FROM lineitem GROUP BY l_orderkey
""")
def pivot_two_parts(spark, sf_dir):
    """Sums of each part as columns (A3)."""
    return rollups.pivot_parts(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "N", "R"], F.col("l_quantity").cast("long"))


@query("""
    SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n_events, arg_min(event_type, (ts, event_id)) AS first_type,
           string_agg(event_type, '|' ORDER BY ts, event_id) AS types
    FROM events GROUP BY ALL
""")
def week_rollup_nested(spark, sf_dir):
    """A week's first attributes, count and joined values in order (A4)."""
    week = F.to_date(F.date_trunc("week", "ts")).alias("week_start")
    rows = table(spark, sf_dir, "events").groupBy("user_id", week).agg(F.count("*").alias("n_events"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("_l"))
    return rows.select("user_id", "week_start", "n_events", "first_type", F.array_join(F.transform("_l", lambda x: x["event_type"]), "|").alias("types"))


@query("""
    SELECT o_orderkey, yearly, weeks, weekly, CASE WHEN weeks IS NOT NULL AND weekly IS NOT NULL THEN 'document'
        WHEN weeks IS NOT NULL AND yearly % weeks = 0 THEN 'derived' WHEN weekly IS NOT NULL AND yearly % weekly = 0 THEN 'derived'
        WHEN yearly = 72 AND coalesce(weeks, 36) = 36 AND coalesce(weekly, 2) = 2 THEN 'derived_36x2' END AS provenance
    FROM (SELECT o_orderkey, CAST(36 * (1 + o_custkey % 4) AS BIGINT) AS yearly,
          CASE WHEN o_orderkey % 3 = 0 THEN CAST(30 + o_orderkey % 8 AS BIGINT) END AS weeks, CASE WHEN o_orderkey % 5 < 2 THEN CAST(1 + o_orderkey % 4 AS BIGINT) END AS weekly FROM orders)
""")
def derived_workload(spark, sf_dir):
    """Where a plan's workload comes from: stated, derived by division, or the standard 36 by 2."""
    from .planning import workload_provenance

    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(key, (36 * (1 + F.col("o_custkey") % 4)).cast("long").alias("yearly"), F.when(key % 3 == 0, (30 + key % 8).cast("long")).alias("weeks"), F.when(key % 5 < 2, (1 + key % 4).cast("long")).alias("weekly"))
    return rows.withColumn("provenance", workload_provenance(F.col("yearly"), F.col("weeks"), F.col("weekly")))


@query("""
    WITH topics AS (SELECT p_partkey AS topic, CAST(p_size AS VARCHAR) AS number, p_name AS title, trim(regexp_replace(lower(p_name), '[^a-zа-я0-9]+', ' ', 'g')) AS norm FROM part),
    items AS (SELECT row_number() OVER (ORDER BY title) AS item, CAST(NULL AS VARCHAR) AS number, title, trim(regexp_replace(lower(title), '[^a-zа-я0-9]+', ' ', 'g')) AS norm
              FROM (SELECT DISTINCT p_name || ' ' || p_type AS title FROM part UNION SELECT DISTINCT upper(p_name) || '!' FROM part WHERE p_size < 40)),
    pairs AS (
        SELECT topic, item, 1 AS level FROM topics t JOIN items i ON t.title = i.title
        UNION ALL SELECT topic, item, 2 FROM topics t JOIN items i ON t.norm = i.norm AND t.norm <> ''
        UNION ALL SELECT topic, item, 3 FROM topics t JOIN items i ON t.number = i.number
        UNION ALL SELECT topic, item, 4 FROM topics t JOIN items i ON len(list_distinct(string_split(t.norm, ' '))) < len(list_distinct(string_split(i.norm, ' '))) AND list_has_all(string_split(i.norm, ' '), string_split(t.norm, ' '))),
    best AS (SELECT topic, item, min(level) AS level FROM pairs GROUP BY ALL),
    top AS (SELECT topic, level, count(*) AS n, min(item) AS item FROM best b WHERE level = (SELECT min(level) FROM best x WHERE x.topic = b.topic) GROUP BY ALL)
    SELECT t.topic, CASE WHEN n = 1 THEN ['EXACT', 'NORMALIZED', 'NUMBER_MATCH', 'TEXT_MATCH'][level] ELSE 'NOT_MATCHED' END AS status,
           CAST(CASE WHEN n = 1 THEN [1.0, 0.95, 0.9, 0.85][level] ELSE 0.0 END AS DOUBLE) AS confidence, CASE WHEN n = 1 THEN item END AS item, coalesce(n, 0) AS n_candidates
    FROM topics t LEFT JOIN top USING (topic)
""")
def priority_match(spark, sf_dir):
    """Part names to catalogue titles by the first level that has a candidate."""
    part = table(spark, sf_dir, "part")
    topics = part.select(F.col("p_partkey").alias("topic_id"), F.col("p_size").cast("string").alias("number"), F.col("p_name").alias("title"), tx.normalise_title(F.col("p_name")).alias("norm"))
    titles = part.select(F.concat_ws(" ", "p_name", "p_type").alias("title")).union(part.where("p_size < 40").select(F.concat(F.upper("p_name"), F.lit("!")))).distinct()
    numbered, _ = number_rows(titles, ["title"])
    items = numbered.select((F.col("row_number") + 1).alias("item_id"), F.lit(None).cast("string").alias("number"), "title", tx.normalise_title(F.col("title")).alias("norm"))
    return matching.priority_match(topics, items)


@query()
def fuzzy_match_topband(spark, sf_dir):
    """Each line of the benchmark texts to the document line most like it, if one stands out."""
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select("item_id", "line", tx.normalise_title(F.col("raw")).alias("norm")).where("norm != ''")
    docs = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).select(tx.normalise_title(F.col("line")).alias("line_norm")).where("line_norm != ''").distinct().withColumn("line_id", F.xxhash64("line_norm"))
    matched = matching.fuzzy_match_all(lines.select("norm").distinct(), docs, "line_id", "norm", "line_norm")
    return lines.join(matched, "norm").select("item_id", "line", "item", "ratio", "n_near")


@query("""
    SELECT doc_id, CAST(line AS INTEGER) AS line, trim(regexp_replace(replace(lower(x), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g')) AS title_norm
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
""")
def title_normalise(spark, sf_dir):
    """Every line of each document normalised."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    return rows.select("doc_id", "line", tx.normalise_title(F.col("x")).alias("title_norm"))


@query("""
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_clauses, CAST(sum(length(c)) AS BIGINT) AS clause_chars, arg_min(c, i) AS first_clause FROM (
        SELECT doc_id, i, regexp_replace(regexp_replace(trim(regexp_replace(p, '[ \\t\\r\\n\\f\\v]+', ' ', 'g')), '^[ .;:]+', ''), '[ .;:]+$', '') AS c FROM (
            SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (
                SELECT doc_id, string_split(replace(regexp_replace(text, '([.!;?])[ \\t\\r\\n\\f\\v]+', '\\1' || chr(10), 'g'), ';', chr(10)), chr(10)) AS parts FROM documents)))
    WHERE c <> '' GROUP BY doc_id
""")
def clause_units(spark, sf_dir):
    """Clauses of each document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tx.clause_units(F.col("text")).alias("clauses")).where(F.size("clauses") > 0)
    chars = F.aggregate("clauses", F.lit(0).cast("long"), lambda a, c: a + F.length(c))
    return rows.select("doc_id", F.size("clauses").cast("long").alias("n_clauses"), chars.alias("clause_chars"), F.get("clauses", F.lit(0)).alias("first_clause"))


@query("""
    SELECT conv_id, turn, CASE WHEN position(chr(10) IN text) > 0 THEN rtrim(left(text, position(chr(10) IN text) - 1)) ELSE text END AS theory_text,
           CASE WHEN position(chr(10) IN text) > 0 THEN ltrim(substr(text, position(chr(10) IN text) + 1)) END AS practice_text
    FROM conversations
""")
def marker_split(spark, sf_dir):
    """Each turn before and after its first marker, here the line end."""
    before, after = tx.split_at_marker(F.col("text"), "\n")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", before.alias("theory_text"), after.alias("practice_text"))


_LABELS = {"en": "the", "de": "der", "fr": "les", "es": "los"}


@query("""
    WITH s AS (SELECT doc_id, label, CAST(len(string_split(' ' || lower(text) || ' ', ' ' || word || ' ')) - 1 AS BIGINT) AS score FROM documents,
        (VALUES ('en', 'the'), ('de', 'der'), ('fr', 'les'), ('es', 'los')) AS v(label, word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS k, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS nxt FROM s)
    SELECT doc_id, CASE WHEN score >= 2 AND score > nxt THEN label END AS label, score AS top_score FROM r WHERE k = 1
""")
def form_scores_dominant(spark, sf_dir):
    """The label whose marker word leads, none on a tie."""
    text = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    scores = F.array(*[F.struct(F.lit(k).alias("label"), (F.size(F.split(text, f" {w} ")) - 1).cast("long").alias("score")) for k, w in _LABELS.items()])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(scores).alias("s")).select("doc_id", "s.label", "s.score")
    return rollups.dominant_label(rows, ["doc_id"], "label", "score", 2)


@query("""
    WITH u AS (SELECT l_orderkey, l_partkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
               WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)),
    f AS (SELECT *, CASE WHEN n >= 3 THEN ((i + 1) * 3 - 1) // n WHEN i < n - 3 % n THEN i * (3 // n) ELSE (n - 3 % n) * (3 // n) + (i - (n - 3 % n)) * (3 // n + 1) END AS a FROM u),
    g AS (SELECT *, CASE WHEN n >= 3 THEN a WHEN i < n - 3 % n THEN a + 3 // n - 1 ELSE a + 3 // n END AS z FROM f)
    SELECT l_orderkey, l_partkey, i AS unit, slot, slot > a AS continued FROM (SELECT *, unnest(range(a, z + 1)) AS slot FROM g)
""")
def slot_assignment(spark, sf_dir):
    """An order's lines dealt to three slots."""
    out = allocation.assign_slots(table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_ORDER), ["l_orderkey"], _LINE_ORDER, 3)
    return out.select("l_orderkey", "l_partkey", "unit", "slot", "continued")


@query("""
    SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence, count(*) OVER (PARTITION BY user_id, event_type) AS appearances FROM events
""")
def occurrence_index_count(spark, sf_dir):
    """Which appearance of its key a row is, and of how many."""
    return sequences.occurrences(table(spark, sf_dir, "events"), ["user_id", "event_type"], _EVENT_ORDER).select("event_id", "occurrence", "appearances")


@query("""
    SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS section FROM conversations
""")
def forward_fill_section(spark, sf_dir):
    """The last heading above each turn."""
    heading = F.when(F.col("role") == "user", F.col("text"))
    return sequences.forward_fill(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "text"], heading, "section").select("conv_id", "turn", "role", "section")


@query("""
    SELECT conv_id, block, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
        SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM conversations)
    GROUP BY ALL
""")
def heading_blocks(spark, sf_dir):
    """Blocks that user turns open."""
    rows = sequences.heading_blocks(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "text"], F.col("role") == "user")
    return rows.groupBy("conv_id", "block").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).alias("chars"))


@query("""
    WITH m AS (SELECT *, date_trunc('month', o_orderdate) AS mon FROM orders),
    n AS (SELECT *, CASE WHEN lag(mon) OVER w IS NOT DISTINCT FROM mon AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n)
    SELECT o_custkey, island, CAST(min(mon) AS DATE) AS month, count(*) AS n_orders FROM i GROUP BY ALL
""")
def month_islands(spark, sf_dir):
    """Runs of orders of one month."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    rows = sequences.islands(table(spark, sf_dir, "orders").withColumn("month", month), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("month"))
    return rows.groupBy("o_custkey", "island").agg(F.min("month").alias("month"), F.count("*").alias("n_orders"))


@query("""
    SELECT user_id, day, next_day, CAST(next_day - day - 1 AS BIGINT) AS free_days FROM (
        SELECT user_id, day, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next_day FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events))
    WHERE next_day - day > 1
""")
def gap_days(spark, sf_dir):
    """Days without an event between a user's days."""
    return sequences.day_gaps(table(spark, sf_dir, "events").withColumn("d", F.to_date("ts")), ["user_id"], "d")


@query("""
    SELECT user_id, string_agg(event_type, ',' ORDER BY first_at) AS types, count(*) AS n_distinct FROM (SELECT user_id, event_type, min((ts, event_id)) AS first_at FROM events GROUP BY ALL) GROUP BY user_id
""")
def ordered_distinct(spark, sf_dir):
    """A user's event types in the order of first occurrence."""
    return rollups.ordered_distinct(table(spark, sf_dir, "events"), ["user_id"], "event_type", _EVENT_ORDER, "types")


@query("""
    SELECT nation, string_agg(DISTINCT w, ';' ORDER BY w) AS warnings, count(DISTINCT w) AS n_warnings FROM (
        SELECT c_nationkey AS nation, 'customer in debt: ' || c_mktsegment AS w FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT s_nationkey, 'supplier in debt' FROM supplier WHERE s_acctbal < 0) GROUP BY nation
""")
def sorted_distinct_union(spark, sf_dir):
    """Warnings of two sources, sorted and distinct."""
    a = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"), F.concat(F.lit("customer in debt: "), "c_mktsegment").alias("w"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"), F.lit("supplier in debt").alias("w"))
    sets = a.unionByName(b).groupBy("nation").agg(F.array_sort(F.collect_set("w")).alias("s"))
    return sets.select("nation", F.array_join("s", ";").alias("warnings"), F.size("s").cast("long").alias("n_warnings"))


@query("""
    WITH a AS (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS custkey FROM orders WHERE year(o_orderdate) = 1997)
    SELECT custkey, 'left' AS side FROM a WHERE custkey NOT IN (SELECT custkey FROM b) UNION ALL SELECT custkey, 'right' FROM b WHERE custkey NOT IN (SELECT custkey FROM a)
""")
def two_sided_difference(spark, sf_dir):
    """Customers with orders in one of two years only."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("y"))
    return rollups.set_differences(keys.where("y = 1996"), keys.where("y = 1997"), "custkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_rows_retry(spark, sf_dir):
    """Requests without an accepted answer."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(lines, "o_orderkey", "left_anti")


@query("""
    SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'checked' WHEN l.quality = 0 THEN 'rejected' ELSE d.source END AS value, l.doc_id IS NOT NULL AS overlaid FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def overlay_fallback(spark, sf_dir):
    """A label where there is one, else the document's own field."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    value = F.when(F.col("quality") == 1, "checked").when(F.col("quality") == 0, "rejected")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.coalesce(F.nullif(value, F.lit("")), "source").alias("value"), F.col("quality").isNotNull().alias("overlaid"))


@query("""
    SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) = 1 AS keeps_value, count(*) OVER (PARTITION BY lower(trim(text))) AS copies FROM documents
""")
def duplicate_keep_first(spark, sf_dir):
    """The first of equal texts keeps its value (W10, A14); texts are compared by a 256-bit digest, so none is shuffled."""
    digests = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("digest"))
    return sequences.first_of_duplicates(digests, F.col("digest"), ["doc_id"]).select("doc_id", "keeps_value", "copies")


@query("""
    SELECT item_id, CAST(len(list_filter(list_distinct(regexp_extract_all(b.text, '[0-9]+')), lambda x: NOT list_contains(regexp_extract_all(d.text, '[0-9]+'), x))) AS BIGINT) AS n_ungrounded, CAST(len(list_distinct(regexp_extract_all(b.text, '[0-9]+'))) AS BIGINT) AS n_numbers
    FROM (SELECT doc_id AS item_id, text FROM documents) b JOIN documents d ON d.doc_id = b.item_id + 1
""")
def number_grounding(spark, sf_dir):
    """Numbers of a text that its source, here the next document, lacks."""
    numbers = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("numbers"))
    source = numbers.select((F.col("doc_id") - 1).alias("item_id"), F.col("numbers").alias("source"))
    pairs = numbers.withColumnRenamed("doc_id", "item_id").join(source, "item_id")
    return pairs.select("item_id", F.size(F.array_except("numbers", "source")).cast("long").alias("n_ungrounded"), F.size("numbers").cast("long").alias("n_numbers"))


@query("""
    WITH p AS (SELECT doc_id, list_distinct(list_transform(list_filter(string_split(lower(text), ' '), lambda x: length(x) >= 4), lambda x: left(x, 4))) AS ps FROM documents)
    SELECT a.doc_id AS item_id, CAST(len(list_filter(a.ps, lambda x: NOT list_contains(b.ps, x))) AS BIGINT) AS n_leaked, CAST(len(a.ps) AS BIGINT) AS n_prefixes FROM p a JOIN p b ON b.doc_id = a.doc_id + 1
""")
def prefix_leakage(spark, sf_dir):
    """Four-letter beginnings of words that the source lacks."""
    words = F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) >= 4)
    prefixes = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.transform(words, lambda x: F.left(x, F.lit(4)))).alias("prefixes"))
    source = prefixes.select((F.col("doc_id") - 1).alias("item_id"), F.col("prefixes").alias("source"))
    pairs = prefixes.withColumnRenamed("doc_id", "item_id").join(source, "item_id")
    return pairs.select("item_id", F.size(F.array_except("prefixes", "source")).cast("long").alias("n_leaked"), F.size("prefixes").cast("long").alias("n_prefixes"))


@query("""
    WITH v AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS valid_from, CASE WHEN o_custkey % 3 > 0 THEN CAST(max(o_orderdate) AS DATE) END AS valid_until FROM orders GROUP BY o_custkey)
    SELECT o_custkey, y AS start_year, coalesce(valid_from <= make_date(y + 1, 8, 31), TRUE) AND coalesce(valid_until >= make_date(y, 9, 1), TRUE) AS in_force FROM v, (SELECT CAST(unnest(range(1995, 2001)) AS INTEGER) AS y)
""")
def validity_overlap(spark, sf_dir):
    """Validity against academic years, open ends included."""
    from .planning import in_force

    day = F.to_date("o_orderdate")
    valid = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(day).alias("valid_from"), F.max(day).alias("last")).withColumn("valid_until", F.when(F.col("o_custkey") % 3 > 0, F.col("last")))
    years = valid.withColumn("start_year", F.explode(F.array(*[F.lit(y) for y in range(1995, 2001)])))
    return years.select("o_custkey", "start_year", in_force(F.col("valid_from"), F.col("valid_until"), F.col("start_year")).alias("in_force"))


@query("""
    WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n_events FROM events GROUP BY ALL)
    SELECT day, n_events, CASE WHEN day IN (DATE '2024-01-01', DATE '2024-01-07') THEN 'holiday' WHEN day = DATE '2024-01-25' THEN 'professional'
        WHEN day BETWEEN DATE '2024-01-02' AND DATE '2024-01-08' THEN 'break' WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'study' END AS day_class FROM d
""")
def day_classification(spark, sf_dir):
    """Days by the first class that fits (F32, U8)."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n_events"))
    d = F.col("day").cast("string")
    kind = cal.day_class(F.col("day"), d.isin("2024-01-01", "2024-01-07"), d == "2024-01-25", d.between("2024-01-02", "2024-01-08"))
    return days.withColumn("day_class", kind)


@query("""
    WITH s AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS q, count(*) AS n FROM lineitem GROUP BY ALL), j AS (SELECT o_orderkey, q, n FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
    SELECT o_orderkey, 'has_lines' AS check_id, CASE WHEN n IS NULL THEN 'not_checked' WHEN n >= 2 THEN 'pass' ELSE 'warning' END AS verdict FROM j
    UNION ALL SELECT o_orderkey, 'even_quantity', CASE WHEN q IS NULL THEN 'not_checked' WHEN q % 2 = 0 THEN 'pass' ELSE 'warning' END FROM j
    UNION ALL SELECT o_orderkey, 'within_load', CASE WHEN q IS NULL THEN 'not_checked' WHEN q <= 72 THEN 'pass' ELSE 'warning' END FROM j
""")
def verdict_union(spark, sf_dir):
    """Several checks with three verdicts as rows."""
    from .planning import verdict

    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(sums, "o_orderkey", "left")
    checks = {"has_lines": F.col("n") >= 2, "even_quantity": F.col("q") % 2 == 0, "within_load": F.col("q") <= 72}
    return rows.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), verdict(c).alias("verdict")) for k, c in checks.items()])).alias("c")).select("o_orderkey", "c.*")


@query("""
    SELECT lang, count(*) AS n_rows, round(100.0 * count(*) FILTER (WHERE l.doc_id IS NOT NULL) / count(*), 1) AS labelled, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 1) AS good
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang
""")
def fill_metrics(spark, sf_dir):
    """How many rows have each field."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rollups.fill_rates(rows, ["lang"], {"labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1})


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_versions FROM events GROUP BY user_id")
def dedupe_latest_version(spark, sf_dir):
    """The latest row of each key."""
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("event_id"), F.max_by("event_type", at).alias("event_type"), F.count("*").alias("n_versions"))


@query("""
    SELECT source, doc_id, rank FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY (lang = 'en')::INT DESC, (n_chars >= 500)::INT DESC, len(string_split(text, chr(10))) DESC, (text LIKE '%the%')::INT DESC, n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 3
""")
def six_key_ranking(spark, sf_dir):
    """The best three of each source by six keys (O3)."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(*[F.col(f"k{i}").desc() for i in range(5)], "doc_id"))
    values = [(F.col("lang") == "en").cast("int"), (F.col("n_chars") >= 500).cast("int"), F.size(F.split("text", "\n")), F.contains("text", F.lit("the")).cast("int"), F.col("n_chars")]
    slim = table(spark, sf_dir, "documents").select("source", "doc_id", *[v.alias(f"k{i}") for i, v in enumerate(values)])
    return slim.withColumn("rank", rank).where("rank <= 3").select("source", "doc_id", "rank")


@query("SELECT p_partkey, string_split(p_name, ' ')[1 + p_partkey % len(string_split(p_name, ' '))] AS picked FROM part")
def round_robin_pick(spark, sf_dir):
    """The word whose turn it is."""
    return table(spark, sf_dir, "part").select("p_partkey", tx.round_robin(F.split("p_name", " "), F.col("p_partkey")).alias("picked"))


@query("""
    SELECT o_custkey, chunk, count(*) AS n_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) // 6 AS chunk FROM orders) GROUP BY ALL
""")
def batch_chunks(spark, sf_dir):
    """Batches of six requests and their sums."""
    rows = sequences.chunk_numbers(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 6, ["o_custkey"])
    return rows.groupBy("o_custkey", "chunk").agg(F.count("*").alias("n_rows"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k, '{"id":' || event_id || ',"k":' || (props ->> '$.k') || '}' AS payload FROM events""")
def json_contract(spark, sf_dir):
    """Parsed properties and a rebuilt payload (F37, F38); invalid JSON gives null."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("payload"))


@query("SELECT page_id, sha256(url || chr(10) || html) AS fingerprint FROM pages")
def fingerprint(spark, sf_dir):
    """A digest of a row's inputs."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.concat_ws("\n", "url", "html"), 256).alias("fingerprint"))


@query(f"""
    SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(unnest(generate_series(start_day, end_day, INTERVAL 1 DAY)) AS DATE) FROM ({_GRID}) WHERE month(start_day) = 10)
""")
def month_semijoin_view(spark, sf_dir):
    """Orders in the weeks that begin in a month."""
    days = cal.week_grid(_years(spark, sf_dir)).where(F.month("start_day") == 10).select(F.explode(F.sequence("start_day", "end_day")).alias("day")).distinct()
    return table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")).join(F.broadcast(days), "day", "left_semi").select("o_orderkey", "o_orderdate")


@query("""
    SELECT l_orderkey, CAST(min(l_linenumber) AS BIGINT) AS first_number, CAST(max(l_linenumber) AS BIGINT) AS last_number, CAST(sum(CASE WHEN step IS NOT NULL AND step NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) AS bad_steps
    FROM (SELECT *, l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS step FROM lineitem) GROUP BY l_orderkey
""")
def consecutive_numbers_check(spark, sf_dir):
    """Line numbers that skip."""
    return sequences.number_steps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _LINE_ORDER, "l_linenumber")


@query("""
    SELECT o_orderkey, sy || '–' || (sy + 1) AS academic_year, CASE WHEN h % 10 = 1 AND h % 100 <> 11 THEN 'час' WHEN h % 10 BETWEEN 2 AND 4 AND h % 100 NOT BETWEEN 12 AND 14 THEN 'часа' ELSE 'часов' END AS hours_word
    FROM (SELECT o_orderkey, year(o_orderdate) - CASE WHEN month(o_orderdate) < 9 THEN 1 ELSE 0 END AS sy, o_orderkey % 130 AS h FROM orders)
""")
def plural_and_year_scalars(spark, sf_dir):
    """Academic years as text and back, and plural forms."""
    sy = cal.start_year_of(F.col("o_orderdate"))
    raw = F.concat(F.lit("план на "), sy.cast("string"), F.lit(" - "), (sy + 1).cast("string"), F.lit(" учебный год"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cal.academic_year(raw).alias("academic_year"), tx.hours_word(F.col("o_orderkey") % 130).alias("hours_word"))


@query("""
    SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[ \\t\\r\\n]+', ' ', 'g')), '') AS title, CAST(coalesce(try_cast(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS INTEGER), 0) AS INTEGER) AS number FROM pages
""")
def page_title_extract(spark, sf_dir):
    """Titles and numbers of pages."""
    title = F.nullif(tx.clean_spaces(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit(""))
    number = tx.lenient_integer(tx.first_capture(F.col("url"), r"/(\d+)"))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), number.alias("number"))
