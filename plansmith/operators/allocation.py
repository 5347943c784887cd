"""Hours into weeks and units into slots, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

def allocate(df: DataFrame, keys: list[str], order_by: list[str], amount: str, capacity: int, bin_name: str = "week", part_name: str = "hours") -> DataFrame:
    """Fill bins of one capacity in order, splitting an amount where a bin ends.

    A running sum e of the amounts places a row on [e - amount, e); it goes to every bin that this stretch touches, with the length
    of its part in each. One window over ``keys`` and no loop, in tasks of a bounded number of rows. Rows without a positive amount are left out; bins count from 1.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt(df.where(F.col(amount) > 0), keys).withColumn("_end", F.sum(amount).over(w)).withColumn("_start", F.col("_end") - F.col(amount))
    size = F.lit(capacity)
    first, last = F.floor(F.col("_start") / size), F.floor((F.col("_end") - 1) / size)
    spread = ends.withColumn("_bin", F.explode(F.sequence(first, last)))
    part = F.least("_end", (F.col("_bin") + 1) * size) - F.greatest("_start", F.col("_bin") * size)
    return spread.withColumn(bin_name, (F.col("_bin") + 1).cast("long")).withColumn(part_name, part.cast("long")).drop("_start", "_end", "_bin")


def load_check(allocated: DataFrame, keys: list[str], capacity: int, bin_name: str = "week", part_name: str = "hours") -> DataFrame:
    """Load of each bin against the capacity: 'full', 'under' or 'over'."""
    load = allocated.groupBy(*keys, bin_name).agg(F.sum(part_name).cast("long").alias("load"))
    return load.withColumn("state", F.when(F.col("load") > capacity, "over").when(F.col("load") < capacity, "under").otherwise("full"))


def slot_of_unit(index: Column, units: Column, slots: int) -> tuple[Column, Column]:
    """First and last slot (from 0) of unit ``index`` when ``units`` units are dealt to ``slots`` slots in order.

    With as many units as slots or more, slot i takes units [i * units div slots, (i + 1) * units div slots). With fewer, every unit
    is stretched over units div slots, and the surplus goes to the last units.
    """
    s = F.lit(slots)
    many_first = F.floor(((index + 1) * s - 1) / units)
    short, surplus = F.floor(s / units), s % units
    plain = units - surplus
    few_first = F.when(index < plain, index * short).otherwise(plain * short + (index - plain) * (short + 1))
    few_last = few_first + F.when(index < plain, short - 1).otherwise(short)
    return F.when(units >= s, many_first).otherwise(few_first).cast("long"), F.when(units >= s, many_first).otherwise(few_last).cast("long")


def assign_slots(df: DataFrame, keys: list[str], order_by: list[str], slots: int) -> DataFrame:
    """One row per unit and slot with ``slot`` from 0 and ``continued``: the unit also filled the slot before."""
    w = Window.partitionBy(*keys)
    counted = df.withColumns({"_i": F.row_number().over(w.orderBy(*order_by)) - 1, "_n": F.count("*").over(w)})
    first, last = slot_of_unit(F.col("_i"), F.col("_n"), slots)
    out = counted.withColumns({"_first": first, "_last": last}).withColumn("slot", F.explode(F.sequence("_first", "_last")))
    return out.withColumn("unit", F.col("_i").cast("long")).withColumn("continued", F.col("slot") > F.col("_first")).drop("_i", "_n", "_first", "_last")
