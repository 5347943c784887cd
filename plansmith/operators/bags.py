"""Comparisons of bags: rows with their repeats, two sides, one verdict a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bag_counts(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """How often each row is on either side: keys, values, ``n_expected``, ``n_actual``. Nulls equal each other.

    Both sides go through one grouping, whose partial counts leave one row for each distinct row and task, so a key with a third of all rows is spread by its values.
    """
    sides = [df.select(*keys, *values, F.lit(n).alias("_side")) for n, df in enumerate((expected, actual))]
    n = {name: F.count_if(F.col("_side") == i).alias(name) for i, name in enumerate(("n_expected", "n_actual"))}
    return sides[0].unionByName(sides[1]).groupBy(*keys, *values).agg(*n.values())


def bag_difference(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows that one side has more often: keys, values, ``side`` ('missing' from actual or 'extra' in it) and ``n``, how many too few or too many."""
    counts = bag_counts(expected, actual, keys, values).where("n_expected != n_actual")
    side = F.when(F.col("n_expected") > F.col("n_actual"), "missing").otherwise("extra")
    return counts.select(*keys, *values, side.alias("side"), F.abs(F.col("n_expected") - F.col("n_actual")).alias("n"))


def bag_verdict(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row a key: ``n_missing``, ``n_extra`` (with repeats) and ``verdict``: pass if the bags are equal, warning if not, not_checked where one side has no row of the key."""
    counts = bag_counts(expected, actual, keys, values)
    more = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0)))
    by = counts.groupBy(*keys).agg(more("n_expected", "n_actual").alias("n_missing"), more("n_actual", "n_expected").alias("n_extra"), F.sum("n_expected").alias("_e"), F.sum("n_actual").alias("_a"))
    verdict = F.when((F.col("_e") == 0) | (F.col("_a") == 0), "not_checked").when((F.col("n_missing") == 0) & (F.col("n_extra") == 0), "pass").otherwise("warning")
    return by.select(*keys, "n_missing", "n_extra", verdict.alias("verdict"))


def set_verdict(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """As :func:`bag_verdict` without repeats: a row counts once on either side."""
    return bag_verdict(expected.select(*keys, *values).distinct(), actual.select(*keys, *values).distinct(), keys, values)
