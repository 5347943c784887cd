"""From a plan's positions to weeks, checks, matched content and the calendar rows, for any number of plans at once.

Tables: ``positions`` as parse_plans gives them (doc_id, pos, kind, number, title, hours, parent_section, standalone), ``workload`` (doc_id, study_weeks,
hours_per_week, start_year), ``items`` (doc_id, pos, number, title, content, parent_section) of the programme that belongs to a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text as tx
from ..operators import matching
from ..session import tasks_for

_TOPIC = ["doc_id", "number", "title", "section"]


def by_plan(df: DataFrame, tasks: int | None) -> DataFrame:
    """``df`` shuffled by plan, once for all the windows and groupings that follow. Tables with the same number of tasks (tasks_for the positions) meet without another shuffle."""
    return df.repartition(tasks, "doc_id") if tasks else df.repartition("doc_id")


def _placed(positions: DataFrame, tasks: int | None) -> DataFrame:
    """Topics in the order of their sections: doc_id, n (from 1), number, title, section, hours, and ``done``, the plan's hours before and with the topic.

    Sections and topics meet in one window by plan and title, so positions are read and shuffled once.
    """
    section = F.col("kind") == "section"
    rows = by_plan(positions.where("kind IN ('section', 'topic')"), tasks).withColumn("_of", F.when(section, F.col("title")).otherwise(F.col("parent_section"))).where("_of IS NOT NULL")
    places = F.collect_list(F.when(section, F.col("pos"))).over(Window.partitionBy("doc_id", "_of"))
    topics = rows.withColumn("_places", places).where("kind = 'topic'").select("doc_id", F.explode("_places").alias("section_pos"), "pos", "number", "title", F.col("parent_section").alias("section"), "hours")
    order = Window.partitionBy("doc_id").orderBy("section_pos", "pos")
    both = sum(F.when(F.col(f"hours.{c}") > 0, F.col(f"hours.{c}")).otherwise(0) for c in ("theory", "practice"))
    return topics.withColumns({"n": F.row_number().over(order), "done": F.sum(both).over(order.rowsBetween(Window.unboundedPreceding, 0))})


def _parts(placed: DataFrame) -> DataFrame:
    """A row for each part of the topics; ``e`` is the plan's hours at the end of the part."""
    theory, practice = F.col("hours.theory"), F.col("hours.practice")
    begun = F.col("done") - F.when(practice > 0, practice).otherwise(0)
    parts = F.array(F.struct((2 * F.col("n") - 1).alias("seq"), F.lit("theory").alias("part_type"), theory.alias("amount"), begun.alias("e")), F.struct((2 * F.col("n")).alias("seq"), F.lit("practice").alias("part_type"), practice.alias("amount"), F.col("done").alias("e")))
    return placed.select(*[c for c in placed.columns if c not in ("n", "hours", "done")], F.inline(parts))


def ordered_parts(positions: DataFrame) -> DataFrame:
    """Theory and practice parts of the topics in the order of their sections: doc_id, seq, number, title, section, part_type, amount.

    A topic belongs to the sections of its parent's title; one whose parent is no section is in none and gets no part.
    """
    return _parts(_placed(positions, tasks_for(positions))).select("doc_id", "seq", "number", "title", "section", "part_type", "amount")


def build_schedule(positions: DataFrame, workload: DataFrame) -> DataFrame:
    """Hours of every part in weeks, by a running sum over each plan's parts: doc_id, seq, number, title, section, part_type, week, hours."""
    load = F.col("hours_per_week")
    tasks = tasks_for(positions)
    placed = _placed(positions, tasks).join(by_plan(workload.select("doc_id", "hours_per_week"), tasks).hint("merge"), "doc_id").where(load > 0)
    ends = _parts(placed).where("amount > 0").withColumn("s", F.col("e") - F.col("amount"))
    spread = ends.withColumn("w", F.explode(F.sequence(F.floor(F.col("s") / load), F.floor((F.col("e") - 1) / load))))
    hours = F.least("e", (F.col("w") + 1) * load) - F.greatest("s", F.col("w") * load)
    return spread.select("doc_id", "seq", "number", "title", "section", "part_type", (F.col("w") + 1).cast("int").alias("week"), hours.cast("int").alias("hours"))


def validate_plan(positions: DataFrame, facts: DataFrame) -> DataFrame:
    """Arithmetic warnings of each plan: doc_id, check_id and detail. ``facts`` as plan_metadata gives them."""
    h = F.col("hours")
    off = h["total"] != h["theory"] + h["practice"]
    text = lambda a, b, c: F.concat(F.lit("("), a, F.lit(", "), b, F.lit(", "), c, F.lit(")"))
    topics = positions.where("kind = 'topic'")
    rows = topics.where(off).select("doc_id", F.lit("topic_hours").alias("check_id"), F.concat(F.coalesce("number", F.lit("без номера")), F.lit(" «"), "title", F.lit("»: "), h["total"], F.lit(" и "), h["theory"] + h["practice"]).alias("detail"))
    sums = topics.groupBy("doc_id", F.col("parent_section").alias("title")).agg(*[F.sum(h[k]).alias(k) for k in ("total", "theory", "practice")])
    sections = positions.where("kind = 'section'").select("doc_id", "title", "hours").join(sums, ["doc_id", "title"])
    differs = (h["total"] != F.col("total")) | (h["theory"] != F.col("theory")) | (h["practice"] != F.col("practice"))
    of_sections = sections.where(differs).select("doc_id", F.lit("section_hours").alias("check_id"), F.concat(F.lit("«"), "title", F.lit("»: "), text(h["total"], h["theory"], h["practice"]), F.lit(" и "), text(F.col("total"), F.col("theory"), F.col("practice"))).alias("detail"))
    all_topics = topics.groupBy("doc_id").agg(*[F.sum(h[k]).alias(k) for k in ("total", "theory", "practice")])
    last = positions.where("kind = 'total'").groupBy("doc_id").agg(F.max_by("hours", "pos").alias("hours"))
    totals = last.join(all_topics, "doc_id", "left").fillna(0, ["total", "theory", "practice"])
    of_total = last.where(off).select("doc_id", F.lit("total_row").alias("check_id"), F.concat(h["total"], F.lit(" и "), h["theory"] + h["practice"]).alias("detail"))
    of_sum = totals.where(differs).select("doc_id", F.lit("total_sum").alias("check_id"), F.concat(text(F.col("total"), F.col("theory"), F.col("practice")), F.lit(" и "), text(h["total"], h["theory"], h["practice"])).alias("detail"))
    f = facts.join(last, "doc_id", "left")
    stated = F.array_compact(F.array("hours_per_year", F.col("study_weeks") * F.col("hours_per_week"), "stated_schedule_hours", h["total"]))
    yearly = f.withColumn("v", stated).where(F.size(F.array_distinct("v")) > 1).select("doc_id", F.lit("yearly_hours").alias("check_id"), F.array_join(F.transform("v", lambda x: x.cast("string")), "; ").alias("detail"))
    return rows.unionByName(of_sections).unionByName(of_total).unionByName(of_sum).unionByName(yearly)


#: What a row of :func:`gathered` is about, and the bits of what stands on it.
TOPIC, WEEK, TOTAL = 1, 2, 3
OURS, THEIRS, GRID, LOADED, PLANNED, STATED = 1, 2, 4, 8, 16, 32
_SLIM = dict(what="tinyint", at="int", number="string", title="string", section="string", bits="int", a="long", b="long", x="int", y="int", z="int")


def gathered(schedule: DataFrame, positions: DataFrame, workload: DataFrame | None = None) -> DataFrame:
    """Schedule and plan side by side in one grouping of few columns: doc_id, what, at, number, title, section, bits, a, b, x, y, z.

    A topic (by number, title and section, nulls equal) has the bits OURS if it is scheduled and THEIRS if the plan has it, and in a and b its theory and practice in the schedule. A week (at), if a
    workload is given, has GRID if it is one of the plan's, LOADED if it is scheduled, its load in a and the plan's hours a week in x; PLANNED is on some row of each plan of the workload. A totals
    row (at: its place) has STATED and theory, practice and total in x, y and z. Each table is read once, and a plan's rows are grouped where they lie.
    """
    row = lambda **have: F.struct(*[(have[c] if isinstance(have.get(c), Column) else F.lit(have.get(c))).cast(t).alias(c) for c, t in _SLIM.items()])
    h, part = F.col("hours"), F.col("part_type")
    of = {c: F.when(part == k, h).otherwise(0) for c, k in (("a", "theory"), ("b", "practice"))}
    rows = [row(what=TOPIC, number=F.col("number"), title=F.col("title"), section=F.col("section"), bits=OURS, **of)]
    if workload is not None:
        rows.append(row(what=WEEK, at=F.col("week"), bits=LOADED, a=h))
    topic = row(what=TOPIC, number=F.col("number"), title=F.col("title"), section=F.coalesce("parent_section", "title"), bits=THEIRS)
    total = row(what=TOTAL, at=F.col("pos"), bits=F.when(h.isNotNull(), STATED).otherwise(0), x=h["theory"], y=h["practice"], z=h["total"])
    tasks = tasks_for(positions)
    plan = by_plan(positions.where("kind IN ('topic', 'total')"), tasks)
    every = schedule.select("doc_id", F.inline(F.array(*rows))).unionByName(plan.select("doc_id", F.when(F.col("kind") == "topic", topic).otherwise(total).alias("r")).select("doc_id", "r.*"))
    if workload is not None:
        weeks = by_plan(workload, tasks).select("doc_id", "hours_per_week", F.explode_outer(F.sequence(F.lit(1), F.col("study_weeks"))).alias("week"))
        week = row(what=WEEK, at=F.col("week"), bits=F.when(F.col("week").isNull(), PLANNED).otherwise(PLANNED | GRID), x=F.col("hours_per_week"))
        every = every.unionByName(weeks.select("doc_id", week.alias("r")).select("doc_id", "r.*"))
    return every.groupBy("doc_id", "what", "at", "number", "title", "section").agg(F.bit_or("bits").alias("bits"), F.sum("a").alias("a"), F.sum("b").alias("b"), *[F.max(c).alias(c) for c in "xyz"])


def has(*bits: int) -> Column:
    """Whether a row of :func:`gathered` has all these bits."""
    return F.col("bits").bitwiseAND(F.lit(sum(bits))) == sum(bits)


def compared() -> list[Column]:
    """Of a plan's rows of :func:`gathered`: ``theory`` and ``practice``, the scheduled hours, ``same``, whether both sides have the same topics, and ``stated``, ``t_theory``, ``t_practice`` and ``t_total`` of its last totals row."""
    what = F.col("what")
    last = F.when(what == TOTAL, F.col("at"))
    hours = [F.sum(F.when((what == TOPIC) & has(OURS), F.col(c))).alias(k) for c, k in (("a", "theory"), ("b", "practice"))]
    return [*hours, F.bool_and(F.when(what == TOPIC, has(OURS, THEIRS))).alias("same"), F.max_by(has(STATED), last).alias("stated"), *[F.max_by(c, last).alias(k) for c, k in (("x", "t_theory"), ("y", "t_practice"), ("z", "t_total"))]]


def validate_schedule(schedule: DataFrame, positions: DataFrame, workload: DataFrame) -> DataFrame:
    """Whether each plan's schedule holds: doc_id and the failed check ids in order of precedence (an empty list passes).

    Checks: total_row_missing, hours (theory, practice or all against the totals row), positions (the scheduled topics are the plan's), overload, empty_hours. The workload has one row for each plan.
    """
    week, load, most = (F.col("what") == WEEK) & (has(GRID) | has(LOADED)), F.col("a"), F.when(has(GRID), F.col("x"))
    over, under = F.when(week, most.isNull() | (load > most)), F.when(week, F.coalesce(load, F.lit(0)) < most)
    by = gathered(schedule, positions, workload).groupBy("doc_id").agg(*compared(), F.bool_or(has(PLANNED)).alias("planned"), F.bool_or(over).alias("over"), F.bool_or(under).alias("under"))
    theory, practice = (F.coalesce(c, F.lit(0)) for c in ("theory", "practice"))
    wrong = F.col("stated") & ((theory != F.col("t_theory")) | (practice != F.col("t_practice")) | (theory + practice != F.col("t_total")))
    checks = [("total_row_missing", ~F.coalesce("stated", F.lit(False))), ("hours", wrong), ("positions", ~F.col("same")), ("overload", F.col("over")), ("empty_hours", F.col("under"))]
    return by.where("planned").select("doc_id", F.array_compact(F.array(*[F.when(c, n) for n, c in checks])).alias("failed"))


def match_items(positions: DataFrame, items: DataFrame) -> DataFrame:
    """Topics of each plan matched to its programme's items: exact, normalised, number, containment, then similarity (doc_id, pos, item_pos, status, confidence).

    The plan is part of every join key, so plans never meet; the similarity level pairs the topics left over with the items of
    their own plan only.
    """
    tag = lambda c: F.concat_ws("\u0002", "doc_id", c)
    words = lambda: F.concat_ws(" ", F.concat(F.lit("\u0003"), "doc_id"), F.col("_norm"))
    named = lambda df, key: df.withColumn("_norm", tx.normalise_title(F.col("title"))).select(F.struct("doc_id", "pos").alias(key), F.when(F.col("number").isNotNull(), tag("number")).alias("number"), tag(F.trim("title")).alias("title"), F.when(F.col("_norm") != "", words()).otherwise("").alias("norm"), F.col("_norm").alias("plain"))
    topics = named(positions.where("kind = 'topic'"), "topic_id")
    theirs = named(items, "item_id")
    level = matching.priority_match(topics, theirs)
    rest = level.where("n_candidates = 0").join(topics.select(F.col("topic_id").alias("topic"), F.col("plain").alias("x")), "topic").withColumn("doc", F.col("topic.doc_id"))
    pairs = rest.join(theirs.select(F.col("item_id.doc_id").alias("doc"), F.col("item_id").alias("other"), F.col("plain").alias("y")), "doc")
    fuzzy = matching.fuzzy_match(pairs.select("topic", "other", "x", "y"), "topic", "other", "x", "y").withColumnsRenamed({"item": "near"})
    out = level.join(fuzzy.select("topic", "near", "ratio", "n_near"), "topic", "left")
    by_ratio = F.col("near").isNotNull()
    return out.select("topic.doc_id", "topic.pos", F.coalesce(F.col("item.pos"), F.col("near.pos")).alias("item_pos"), F.when(by_ratio, "TEXT_MATCH").otherwise(F.col("status")).alias("status"), F.when(by_ratio, F.col("ratio")).otherwise(F.col("confidence")).alias("confidence"))


def week_parts(schedule: DataFrame, positions: DataFrame, matches: DataFrame, items: DataFrame) -> DataFrame:
    """One row per week and topic in order of first appearance: hours of both kinds and the matched content.

    Topics meet their matches by number, title and parent section, nulls equal; a repeated topic takes its last match.
    """
    sums = schedule.groupBy("doc_id", "week", "number", "title", "section").agg(F.min("seq").alias("part_pos"), F.coalesce(F.sum(F.when(F.col("part_type") == "theory", F.col("hours"))), F.lit(0)).cast("int").alias("theory_hours"), F.coalesce(F.sum(F.when(F.col("part_type") == "practice", F.col("hours"))), F.lit(0)).cast("int").alias("practice_hours"))
    found = positions.where("kind = 'topic'").select("doc_id", "pos", "number", "title", F.col("parent_section").alias("section")).join(matches, ["doc_id", "pos"])
    found = found.groupBy("doc_id", "number", "title", "section").agg(F.max_by(F.struct("item_pos", "status"), "pos").alias("m"))
    item = items.select(F.col("doc_id").alias("_d"), F.col("pos").alias("_p"), F.col("title").alias("program_topic"), F.col("content").alias("program_content"), F.col("parent_section").alias("program_section"))
    s, f = sums.alias("s"), found.alias("f")
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"f.{c}")) for c in _TOPIC]
    j = s.join(f, on, "left").select("s.*", "m").join(item, (F.col("doc_id") == F.col("_d")) & (F.col("m.item_pos") == F.col("_p")), "left")
    warning = F.when(F.col("_p").isNull(), F.concat(F.lit("Тема УТП «"), "title", F.lit("» не сопоставлена с программой.")))
    return j.select("doc_id", "week", "part_pos", "number", "title", "section", "theory_hours", "practice_hours", F.coalesce("m.status", F.lit("NOT_MATCHED")).alias("match_status"), F.coalesce("program_section", F.lit("")).alias("program_section"), F.coalesce("program_topic", F.lit("")).alias("program_topic"), F.coalesce("program_content", F.lit("")).alias("program_content"), F.array_compact(F.array(warning)).alias("warnings"))


def calendar_rows(parts: DataFrame, workload: DataFrame) -> DataFrame:
    """One row per plan and week: the first topic's fields, summed hours, contents in order, distinct warnings, and the parts themselves."""
    part = F.struct("part_pos", "number", "title", "section", "theory_hours", "practice_hours", "match_status", "program_section", "program_topic", "program_content", "warnings")
    by = parts.groupBy("doc_id", "week").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("theory_hours").cast("int").alias("theory_hours"), F.sum("practice_hours").cast("int").alias("practice_hours"))
    years = workload.select("doc_id", "start_year")
    weeks = cal.week_grid(years.select("start_year")).withColumnRenamed("week", "_week")
    first = F.get("parts", F.lit(0))
    content = F.array_join(F.filter(F.transform("parts", lambda p: p["program_content"]), lambda c: c != ""), "\n")
    rows = by.join(years, "doc_id").join(F.broadcast(weeks), ["start_year"]).where(F.col("week") == F.col("_week"))  # 36 rows a year
    return rows.select("doc_id", "week", "date_range", F.col("month_label").alias("month"), first["section"].alias("section"), first["number"].alias("topic_number"), first["title"].alias("topic_title"), "theory_hours", "practice_hours", (F.col("theory_hours") + F.col("practice_hours")).alias("total_hours"), first["match_status"].alias("match_status"), first["program_section"].alias("program_section"), first["program_topic"].alias("program_topic"), content.alias("program_content_full"), tx.preview(content).alias("program_content_preview"), F.array_distinct(F.flatten(F.transform("parts", lambda p: p["warnings"]))).alias("warnings"), "parts")


def ordered_calendar(rows: DataFrame) -> DataFrame:
    """Calendar rows in the order of plans and weeks, for reading out (O8): a range sort, no single task."""
    return rows.sort("doc_id", "week")


def write_snapshot(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Publish calendar rows: nested as Parquet or JSON, or flat as CSV."""
    flat = rows.withColumn("warnings", F.array_join("warnings", "; ")).drop("parts") if fmt == "csv" else rows
    flat.write.mode("overwrite").format(fmt).option("header", "true").save(path)
