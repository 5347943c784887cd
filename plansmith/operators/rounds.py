"""Rounds over what is still open, comparisons row by row, and answers in JSON that may be cut off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage

#: Fixed value: the first attempt and three more.
ROUNDS = 4


def retry_rounds(requests: DataFrame, keys: list[str], attempt: Callable[[DataFrame, int], DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Answers of up to ``rounds`` attempts, each over the requests that have none yet, and the requests left over.

    ``attempt`` gets the open requests and the round's number from 1 and returns accepted answers with the keys; if it answers a request twice, each row stays. An
    attempt is staged before the next begins, so no round is asked twice.
    """
    left, answers = requests, None
    for i in range(1, rounds + 1):
        got, _ = stage(attempt(left, i).withColumn("round", F.lit(i)), "round")
        answers = got if answers is None else answers.unionByName(got)
        left, _ = stage(left.join(got.select(*keys).distinct(), keys, "left_anti"), "left")
    return answers, left


def compared(ours: DataFrame, theirs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of both sides by key, with ``equal`` for all values and ``side`` that has them: both, ours or theirs."""
    a = ours.select(*keys, F.struct(*values).alias("_ours"))
    b = theirs.select(*keys, F.struct(*values).alias("_theirs"))
    both = a.join(b, keys, "full")
    side = F.when(F.col("_theirs").isNull(), "ours").when(F.col("_ours").isNull(), "theirs").otherwise("both")
    return both.select(*keys, side.alias("side"), (F.col("_ours").isNotNull() & F.col("_ours").eqNullSafe(F.col("_theirs"))).alias("equal"))


def matched_rows(ours: DataFrame, theirs: DataFrame, keys: list[str], message: str = "rows do not match") -> DataFrame:
    """Rows of both sides side by side, where each key must stand once on either side (J8): keys, our columns, and theirs that ours lack.

    A key that a side lacks, or has twice, fails the job with ``message`` and the key; the check is part of the one join, so no second pass counts rows.
    """
    others = [c for c in theirs.columns if c not in ours.columns]
    sides = [df.groupBy(*keys).agg(F.first(F.struct(*[c for c in cols])).alias(name), F.count("*").alias(f"{name}_n")) for df, cols, name in ((ours, ours.columns, "_ours"), (theirs, theirs.columns, "_theirs"))]
    both = sides[0].join(sides[1], keys, "full")
    one = (F.coalesce("_ours_n", F.lit(0)) == 1) & (F.coalesce("_theirs_n", F.lit(0)) == 1)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    checked = F.when(one, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), key)).cast("boolean"))
    return both.where(checked).select(*[F.col(f"_ours.`{c}`").alias(c) for c in ours.columns], *[F.col(f"_theirs.`{c}`").alias(c) for c in others])


def zipped(first: Column, second: Column) -> Column:
    """Two lists of a row as one of pairs (a, b), place by place; the shorter goes on with nulls."""
    return F.transform(F.arrays_zip(first.alias("a"), second.alias("b")), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))


def shared_context(df: DataFrame, keys: list[str], context: list[str]) -> DataFrame:
    """Per key whether all its rows share one context; nulls are a value."""
    return df.groupBy(*keys).agg((F.countDistinct(F.to_json(F.struct(*context), {"ignoreNullFields": "false"})) == 1).alias("shared"))


def accepted_phrases(df: DataFrame, keys: list[str], order_by: list[str], phrase: str) -> DataFrame:
    """Per key the phrases that are not blank, in order, each once."""
    some = df.where(F.trim(phrase) != "").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order_by, F.col(phrase).alias("_phrase")))).alias("_all"))
    return some.select(*keys, F.array_distinct(F.transform("_all", lambda x: x["_phrase"])).alias("phrases"))


def bare_json(x: Column) -> Column:
    """An answer without a fence of backticks around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def json_rows(x: Column, row: str) -> Column:
    """The rows of an answer: an array, one object, or of an array that is cut off the flat objects that are whole. ``row`` is their DDL; none gives an empty array."""
    text = bare_json(x)
    one = F.from_json(F.when(F.startswith(text, F.lit("{")), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), f"array<{row}>", {"mode": "PERMISSIVE"})
    whole = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), 1), lambda o: F.from_json(o, row)), lambda o: o.isNotNull())
    closed = F.regexp_like(text, F.lit(r"[\]}]$"))
    return F.coalesce(F.when(closed, one), whole)
