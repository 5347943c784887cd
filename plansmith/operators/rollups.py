"""Sums of parts against declared totals, pivots, ordered distinct lists, label scores and fill rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_parts(df: DataFrame, keys: list[str], part: str, parts: list[str], value: Column) -> DataFrame:
    """One column of sums for each part, 0 where there is none."""
    sums = [F.coalesce(F.sum(F.when(F.col(part) == p, value)), F.lit(0)).alias(p) for p in parts]
    return df.groupBy(*keys).agg(*sums)


def totals_check(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, declared: str, value: Column) -> DataFrame:
    """Declared totals against the sum of the children; parents without children are left out."""
    sums = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.sum(value).alias("children_total"), F.count("*").alias("n_children"))
    return parents.join(sums, parent_key).select(parent_key, F.col(declared).alias("declared_total"), "children_total", "n_children")


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order_by: list[str], name: str, sep: str = ",") -> DataFrame:
    """Each key's distinct values in the order of their first occurrence, as one string.

    Values are grouped with the place of their first row before any list is made, so a list holds distinct values only.
    """
    place = F.struct(*order_by)
    firsts = df.groupBy(*keys, value).agg(F.min(place).alias("_at"))
    listed = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("_v")))).alias("_l"), F.count("*").alias("n_distinct"))
    return listed.select(*keys, F.array_join(F.transform("_l", lambda x: x["_v"]), sep).alias(name), "n_distinct")


def dominant_label(scores: DataFrame, keys: list[str], label: str, score: str, least: int) -> DataFrame:
    """The label of the highest score if it reaches ``least`` and no other label ties it, else null."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(label))
    ranked = scores.withColumns({"_rank": F.row_number().over(w), "_next": F.lead(score).over(w)}).where("_rank = 1")
    sure = (F.col(score) >= least) & (F.col("_next").isNull() | (F.col(score) > F.col("_next")))
    return ranked.select(*keys, F.when(sure, F.col(label)).alias("label"), F.col(score).alias("top_score"))


def fill_rates(df: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """Percentage of rows whose field is non-empty, to one decimal; 100 where there are no rows to fill."""
    total = F.count("*")
    rate = {n: F.coalesce(F.round(100.0 * F.count_if(c) / F.when(total > 0, total), 1), F.lit(100.0)) for n, c in fields.items()}
    return df.groupBy(*keys).agg(total.alias("n_rows"), *[c.alias(n) for n, c in rate.items()])


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that has them; both empty means the sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def filled_bins(bins: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Aggregates of ``rows`` for every one of the ``bins``; 0 where a bin has none."""
    sums = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in values.items()])
    return bins.join(sums, keys, "left").select(*keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in values])
