"""School-calendar functions: academic years, the week grid, labels and day classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names by number, the approved grid's break of 2026-2027.
MONTHS = ["Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь"]
APPROVED_START, APPROVED_LAST_BEFORE_BREAK, APPROVED_RESUME = 2026, "2026-12-30", "2027-01-11"
WEEKS = 36
#: Month names after a day's number.
MONTHS_OF = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]


def academic_year(x: Column) -> Column:
    """``YYYY–YYYY`` from a text with YYYY-YYYY or YYYY/YY, end = start + 1, 1990 to 2100; else null. A full pair goes first, even a wrong one."""
    pair = r"(\d{4})\s*[-–—/]\s*(\d{4})"
    short = r"(\d{4})\s*[/]\s*(\d{2})(?!\d)"
    is_pair = F.regexp_like(x, F.lit(pair))
    a = F.when(is_pair, F.regexp_extract(x, pair, 1)).otherwise(F.regexp_extract(x, short, 1)).try_cast("int")
    b = F.when(is_pair, F.regexp_extract(x, pair, 2).try_cast("int")).otherwise(F.regexp_extract(x, short, 2).try_cast("int") + F.floor(a / 100) * 100)
    b = F.when(~is_pair & (b < a), b + 100).otherwise(b)
    ok = (b == a + 1) & a.between(1990, 2100)
    return F.when(ok, F.concat(a.cast("string"), F.lit("–"), b.cast("string")))


def start_year_of(day: Column) -> Column:
    """The academic year that a day lies in starts on 1 September."""
    return F.year(day) - F.when(F.month(day) < 9, 1).otherwise(0)


def month_label(start: Column, end: Column) -> Column:
    """The month's name, or both where a week crosses into the next."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    a, b = F.get(names, F.month(start) - 1), F.get(names, F.month(end) - 1)
    return F.when(F.month(start) == F.month(end), a).otherwise(F.concat(a, F.lit(" / "), b))


def date_range(start: Column, end: Column) -> Column:
    """``dd–dd.MM`` within a month, ``dd.MM–dd.MM`` across two."""
    return F.when(F.month(start) == F.month(end), F.concat(F.date_format(start, "dd"), F.lit("–"), F.date_format(end, "dd.MM"))).otherwise(F.concat(F.date_format(start, "dd.MM"), F.lit("–"), F.date_format(end, "dd.MM")))


def clean_words(x: Column) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _month_of(day: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTHS_OF]), F.month(day) - 1)


def week_caption(start: Column, end: Column) -> Column:
    """``7–13 сентября`` within a month, ``28 сентября — 4 октября`` across two."""
    a, b = F.dayofmonth(start).cast("string"), F.dayofmonth(end).cast("string")
    same = F.concat(a, F.lit("–"), b, F.lit(" "), _month_of(end))
    return F.when(F.month(start) == F.month(end), same).otherwise(F.concat(a, F.lit(" "), _month_of(start), F.lit(" — "), b, F.lit(" "), _month_of(end)))


def break_caption(start: Column, end: Column) -> Column:
    """A break's days with the year, or both years where it crosses into the next."""
    a, b, one, two = F.dayofmonth(start).cast("string"), F.dayofmonth(end).cast("string"), F.year(start).cast("string"), F.year(end).cast("string")
    across = F.concat_ws(" ", a, _month_of(start), one, F.lit("—"), b, _month_of(end), two)
    return F.when(one != two, across).otherwise(F.concat(week_caption(start, end), F.lit(" "), two))


def adjacent_month(day: Column, delta: int) -> Column:
    """The first day of the month so many months on, null outside the academic year of ``day``."""
    first = F.make_date(start_year_of(day), F.lit(9), F.lit(1))
    to = F.add_months(F.trunc(day, "month"), delta)
    return F.when(to.between(first, F.add_months(first, 11)), to)


def week_grid(years: DataFrame, start_year: str = "start_year", weeks: int = WEEKS) -> DataFrame:
    """Weeks 1 to 36 of each start year, one row each: first and last day, label and range.

    The first week runs from 1 September to its Sunday, the others from Monday to Sunday. 2026 follows the approved grid: the week at
    the turn of the year ends on 30 December and study resumes on 11 January.
    """
    first = F.make_date(F.col(start_year), F.lit(9), F.lit(1))
    first_end = F.date_add(first, 6 - F.weekday(first))
    n = F.col("week")
    rows = years.select(start_year).distinct().withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
    monday = F.date_add(first_end, (n - 2) * 7 + 1)
    start = F.when(n == 1, first).otherwise(monday)
    last = F.lit(APPROVED_LAST_BEFORE_BREAK).cast("date")
    resume = F.lit(APPROVED_RESUME).cast("date")
    approved = F.col(start_year) == APPROVED_START
    full = F.datediff(last, first_end) / 7
    before = F.ceil(full).cast("int") + 1  # the short week's number
    start = F.when(approved & (n > before), F.date_add(resume, (n - before - 1) * 7)).otherwise(start)
    rows = rows.withColumn("start_day", start)
    end = F.when(n == 1, first_end).otherwise(F.date_add("start_day", 6))
    end = F.when(approved & (n == before), last).otherwise(end)
    rows = rows.withColumn("end_day", end)
    return rows.select(start_year, F.col("week").cast("long"), "start_day", "end_day", month_label(F.col("start_day"), F.col("end_day")).alias("month_label"), date_range(F.col("start_day"), F.col("end_day")).alias("date_range"))


def day_class(day: Column, is_holiday: Column, is_professional: Column, is_break: Column) -> Column:
    """Holiday before professional date before break before weekend; every other day is for study."""
    return F.when(is_holiday, "holiday").when(is_professional, "professional").when(is_break, "break").when(F.weekday(day) >= 5, "weekend").otherwise("study")
