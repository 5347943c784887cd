"""Constant tables of a plan's surroundings: regulations by version, breaks and holidays; the rules that they have to keep; the days of a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal

#: Breaks of the approved year (title, first day, last day, first classes only).
BREAKS = [
    ("Осенние каникулы", "2026-10-26", "2026-11-03", False),
    ("Зимние каникулы", "2026-12-31", "2027-01-10", False),
    ("Дополнительные каникулы для 1 класса", "2027-02-15", "2027-02-21", True),
    ("Весенние каникулы", "2027-03-27", "2027-04-04", False),
    ("Летние каникулы", "2027-05-27", "2027-08-31", False),
]
#: Holidays and the professional date.
HOLIDAYS = ["2026-11-04", "2026-12-31", "2027-01-01", "2027-01-02", "2027-01-03", "2027-01-04", "2027-01-05", "2027-01-06", "2027-01-07", "2027-01-08", "2027-02-23", "2027-03-08", "2027-05-01", "2027-05-09", "2027-06-12"]
PROFESSIONAL = ["2026-10-05"]
#: Classes that count as first.
FIRST_CLASSES = ["1", "1а", "1б", "1в", "1г", "1д"]


def is_first_class(name):
    """Whether a class name means a first class, with or without the word for class."""
    return cal.clean_words(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("класс"), F.lit(""))).isin(*FIRST_CLASSES)


def breaks(spark: SparkSession) -> DataFrame:
    """The approved year's breaks: title, first and last day, whether for first classes only, caption."""
    rows = spark.createDataFrame(BREAKS, "title string, first_day string, last_day string, first_class_only boolean")
    rows = rows.withColumns({c: F.to_date(c) for c in ("first_day", "last_day")})
    return rows.withColumn("caption", cal.break_caption(F.col("first_day"), F.col("last_day")))


def break_days(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """Each class's days of recommended breaks: class_name, day, title."""
    rows = classes.select("class_name", is_first_class(F.col("class_name")).alias("first_class"))
    days = breaks(spark).select("title", "first_class_only", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    return rows.join(F.broadcast(days), ~F.col("first_class_only") | F.col("first_class")).select("class_name", "day", "title")  # five breaks


def year_days(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """Every day of the approved academic year for each class with its kind, and whether its week is short.

    Breaks are the recommended ones and the days between weeks of the grid.
    """
    start = F.make_date(F.lit(cal.APPROVED_START), F.lit(9), F.lit(1))
    days = spark.range(1).select(F.explode(F.sequence(start, F.date_sub(F.add_months(start, 12), 1))).alias("day"))
    grid = cal.week_grid(spark.createDataFrame([(cal.APPROVED_START,)], "start_year int")).select("start_day", "end_day")
    study = grid.select(F.explode(F.sequence("start_day", "end_day")).alias("day"), (F.datediff("end_day", "start_day") < 6).alias("short_week"))
    last = grid.agg(F.max("end_day").alias("last_day"))
    special = spark.createDataFrame([(d, "holiday") for d in HOLIDAYS] + [(d, "professional") for d in PROFESSIONAL], "day string, special string").withColumn("day", F.to_date("day"))
    calendar = days.join(study, "day", "left").join(special, "day", "left").crossJoin(last)  # a year of days and one row
    each = classes.select("class_name").distinct().join(F.broadcast(calendar))
    rows = each.join(break_days(spark, classes.select("class_name").distinct()), ["class_name", "day"], "left")
    off = F.col("title").isNotNull() | (F.col("short_week").isNull() & (F.col("day") < F.col("last_day")))
    weekend = F.weekday("day") >= 5
    kind = F.coalesce("special", F.when(off & weekend, "break weekend").when(off, "break").when(weekend, "weekend").when(F.col("short_week").isNotNull(), "study").otherwise("none"))
    return rows.select("class_name", "day", kind.alias("kind"), F.coalesce("short_week", F.lit(False)).alias("short_week"))


def registry_faults(documents: DataFrame) -> DataFrame:
    """Rules that registered documents break, a row for each: version, number, rule.

    ``documents``: version, number, title, official_url, document_date, effective_from, effective_until, verified_on. Blank fields, addresses that
    are not https, validity that ends before it begins, and documents verified before their date are faults.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = {
        "blank_number": blank("number"),
        "blank_title": blank("title"),
        "address": ~F.startswith(F.coalesce("official_url", F.lit("")), F.lit("https://")),
        "validity": F.col("effective_until") < F.col("effective_from"),
        "verified_too_early": F.col("verified_on") < F.col("document_date"),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return documents.select("version", "number", F.explode(found).alias("rule"))


def latest_version(documents: DataFrame) -> DataFrame:
    """The documents of the highest version."""
    return documents.join(F.broadcast(documents.agg(F.max("version").alias("version"))), "version")  # one row


def history_faults(documents: DataFrame, name: str = "number", version: str = "version", since: str = "effective_from") -> DataFrame:
    """What is wrong with the history of each document, a row for each row and rule (P34): document, version, ``rule``.

    A version must be given once ('repeated_version'), and a higher version must not be in force before a lower one ('order', at the higher one). Null versions are faults ('no_version'); null dates are
    in no order. One window a document.
    """
    of = Window.partitionBy(name).orderBy(version)
    latest = F.max(F.when(F.col(version).isNotNull(), F.col(since))).over(of.rangeBetween(Window.unboundedPreceding, -1))  # of all lower versions
    rules = {"no_version": F.col(version).isNull(), "repeated_version": F.col(version).isNotNull() & (F.count("*").over(Window.partitionBy(name, version)) > 1), "order": F.col(version).isNotNull() & (F.col(since) < latest)}
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return documents.withColumn("_found", found).select(name, version, F.explode("_found").alias("rule"))
