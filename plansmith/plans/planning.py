"""Rules of planning data: workload, validity and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def workload_provenance(yearly: Column, weeks: Column, weekly: Column) -> Column:
    """Where weeks and hours a week come from: 'document', 'derived' by division, 'derived_36x2', or null where nothing fits."""
    by_weeks = weeks.isNotNull() & weekly.isNull() & (weeks > 0) & (F.try_mod(yearly, weeks) == 0)
    by_load = weekly.isNotNull() & weeks.isNull() & (weekly > 0) & (F.try_mod(yearly, weekly) == 0)
    standard = (yearly == 72) & (F.coalesce(weeks, F.lit(36)) == 36) & (F.coalesce(weekly, F.lit(2)) == 2)
    return F.when((weeks > 0) & (weekly > 0), "document").when(by_weeks, "derived").when(by_load, "derived").when(standard, "derived_36x2")


def in_force(valid_from: Column, valid_until: Column, start_year: Column) -> Column:
    """Whether a validity period, open where an end is null, meets 1 September to 31 August."""
    begin, end = F.make_date(start_year, F.lit(9), F.lit(1)), F.make_date(start_year + 1, F.lit(8), F.lit(31))
    return F.coalesce(valid_from <= end, F.lit(True)) & F.coalesce(valid_until >= begin, F.lit(True))


def verdict(passed: Column) -> Column:
    """'pass', 'warning', or 'not_checked' where the condition is null."""
    return F.when(passed.isNull(), "not_checked").when(passed, "pass").otherwise("warning")
