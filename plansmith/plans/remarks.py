"""What a reader sees of checks and warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of warnings of safe templates. The message that stands for all of them is our own.
SAFE_WARNING = r"^Безопасный шаблон CE2:\s*[a-z][a-z0-9_]*\.$"
SAFE_MESSAGE = "Часть текстов заменена нейтральными."


def visible_remarks(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings and unchecked rows of ``checks`` (keys, check_id, verdict), but short weeks, and a missing duration if the study year is found and could not be compared.

    Missing durations alone meet the keys that hide them, by a shuffled join: keys are as many as plans, too many to be sent whole through the driver.
    """
    of = lambda name, verdict: (F.col("check_id") == name) & (F.col("verdict") == verdict)
    found, unsure = of("study_year_found", "pass"), of("year_within_duration", "not_checked")
    hides = checks.where(found | unsure).groupBy(*keys).agg(F.bool_or(found).alias("_found"), F.bool_or(unsure).alias("_unsure")).where("_found AND _unsure")
    shown = checks.where(F.col("verdict").isin("warning", "not_checked") & ~of("short_week_full_load", "warning"))
    missing = of("duration_found", "warning")
    hidden = hides.select(*[F.col(k).alias(f"_{k}") for k in keys]).hint("merge")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return shown.where(~missing).unionByName(shown.where(missing).join(hidden, same, "left_anti"))


def reader_warnings(warnings: Column, internal: list[str]) -> Column:
    """Warnings for a reader: internal ones go, and all of safe templates become one message at the end."""
    safe = lambda w: F.regexp_like(w, F.lit(SAFE_WARNING))
    shown = F.filter(warnings, lambda w: ~w.isin(*internal) & ~safe(w))
    return F.when(F.exists(warnings, safe), F.concat(shown, F.array(F.lit(SAFE_MESSAGE)))).otherwise(shown)
