"""Operators that carry state along an order: fills, islands, gaps, occurrences, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import free_name


def _running(keys: list[str], order_by: list[str]):
    return Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(df: DataFrame, keys: list[str], order_by: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_running(keys, order_by)))


def heading_blocks(df: DataFrame, keys: list[str], order_by: list[str], is_heading: Column, name: str = "block") -> DataFrame:
    """Number the blocks that headings open; rows before the first heading are block 0."""
    return df.withColumn(name, F.sum(F.when(is_heading, 1).otherwise(0)).over(_running(keys, order_by)).cast("long"))


def islands(df: DataFrame, keys: list[str], order_by: list[str], value: Column, name: str = "island") -> DataFrame:
    """Number the runs of equal neighbouring values from 1; nulls equal each other."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    own, opens = free_name(df, "value"), free_name(df, "opens")
    marked = df.withColumn(own, value)
    new = F.row_number().over(w).eqNullSafe(F.lit(1)) | ~F.lag(own).over(w).eqNullSafe(F.col(own))
    return marked.withColumn(opens, new.cast("int")).withColumn(name, F.sum(opens).over(_running(keys, order_by)).cast("long")).drop(own, opens)


def occurrences(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """``occurrence`` from 0 within the key and ``appearances``, the key's rows."""
    w = Window.partitionBy(*keys)
    return df.withColumns({"occurrence": (F.row_number().over(w.orderBy(*order_by)) - 1).cast("long"), "appearances": F.count("*").over(w)})


def day_gaps(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Gaps of whole days between neighbouring distinct days: the days before and after, and the free days between."""
    days = df.select(*keys, F.col(day).alias("day")).distinct()
    nxt = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
    return days.withColumn("next_day", nxt).withColumn("free_days", (F.datediff("next_day", "day") - 1).cast("long")).where("free_days > 0")


def number_steps(df: DataFrame, keys: list[str], order_by: list[str], number: str, allowed: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Per key: first and last number and how many steps between neighbours are not allowed."""
    step = F.col(number) - F.lag(number).over(Window.partitionBy(*keys).orderBy(*order_by))
    at = free_name(df, "step")
    bad = F.when(F.col(at).isNotNull() & ~F.col(at).isin(*allowed), 1).otherwise(0)
    return df.withColumn(at, step).groupBy(*keys).agg(F.min(number).cast("long").alias("first_number"), F.max(number).cast("long").alias("last_number"), F.sum(bad).cast("long").alias("bad_steps"))


def first_of_duplicates(df: DataFrame, same: Column, order_by: list[str], name: str = "keeps_value") -> DataFrame:
    """Whether a row is the first with its value; ``copies`` counts the rows that share it. Null values are never duplicates.

    Rows without a value keep out of the window, so they never meet in one task.
    """
    own = free_name(df, "same")
    w = Window.partitionBy(own)
    marked = df.withColumn(own, same)
    some = marked.where(F.col(own).isNotNull()).withColumn("copies", F.count("*").over(w)).withColumn(name, F.row_number().over(w.orderBy(*order_by)) == 1)
    none = marked.where(F.col(own).isNull()).withColumn("copies", F.lit(1).cast("long")).withColumn(name, F.lit(True))
    return some.unionByName(none).drop(own)


def display_numbers(df: DataFrame, section: list[str], order_by: list[str], section_number: Column, number: Column, standalone: Column, name: str = "display_number") -> DataFrame:
    """A topic's number without last dots; one without is its section's if it stands alone, else the section's with a count of such topics. ``?`` for a section without number."""
    own = F.rtrim(number, F.lit("."))
    of_section = F.coalesce(F.nullif(F.rtrim(section_number, F.lit(".")), F.lit("")), F.lit("?"))
    bare, alone = free_name(df, "bare"), free_name(df, "alone")
    k = F.sum(F.when(F.col(bare) & ~F.col(alone), 1).otherwise(0)).over(_running(section, order_by))
    marked = df.withColumns({bare: number.isNull() | (number == ""), alone: standalone})
    return marked.withColumn(name, F.when(~F.col(bare), own).when(F.col(alone), of_section).otherwise(F.concat_ws(".", of_section, k.cast("string")))).drop(bare, alone)


def captured_after(df: DataFrame, keys: list[str], order_by: list[str], is_heading: Column, is_stop: Column, name: str = "captured", heading_name: str | None = None) -> DataFrame:
    """Whether a row lies after a heading and before the first stop that follows one; headings are not captured, and after that stop nothing is.

    ``heading_name`` adds whether a row is a heading before that stop.
    """
    w = _running(keys, order_by)
    head, stop, opened, ended = (free_name(df, x) for x in ("heading", "stop", "opened", "ended"))
    out = df.withColumns({head: F.coalesce(is_heading, F.lit(False)), stop: F.coalesce(is_stop, F.lit(False))})
    out = out.withColumn(opened, F.max(F.col(head).cast("int")).over(w) == 1)
    out = out.withColumn(ended, F.max((F.col(opened) & ~F.col(head) & F.col(stop)).cast("int")).over(w) == 1)
    out = out.withColumn(name, F.col(opened) & ~F.col(ended) & ~F.col(head))
    if heading_name:
        out = out.withColumn(heading_name, F.col(head) & ~F.col(ended))
    return out.drop(head, stop, opened, ended)


def marked_modes(df: DataFrame, keys: list[str], order_by: list[str], marker: Column, name: str = "mode") -> DataFrame:
    """The last marker up to each row and whether the row is one itself; rows before the first have no mode."""
    own = free_name(df, "marker")
    out = df.withColumn(own, marker)
    return out.withColumns({name: F.last(own, ignorenulls=True).over(_running(keys, order_by)), f"is_{name}_marker": F.col(own).isNotNull()}).drop(own)


def chunk_numbers(df: DataFrame, order_by: list[str], size: int, keys: list[str], name: str = "chunk") -> DataFrame:
    """Number chunks of ``size`` rows from 0 within each key."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(name, F.floor((F.row_number().over(w) - 1) / F.lit(size)).cast("long"))
