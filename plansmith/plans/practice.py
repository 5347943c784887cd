"""Practice of topics that come up in several weeks: their units dealt to the weeks, and the texts of a calendar's cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sequences
from . import clauses

#: Stems of sentences that speak of practice.
PRACTICE_STEMS = ["составлен", "разработ", "отработ", "подбор", "выбор", "выполн", "изучен", "определ", "организа", "приготов", "уклад", "ремонт", "изготов", "обработ", "оформлен", "проведен", "наблюден", "сравнен", "измерен", "работ", "отчёт", "движен", "ориентир", "применен", "закупк", "фасовк", "упаковк", "сдач", "подготовк", "выступлен"]


def practice_text(content: Column) -> Column:
    """What follows the explicit practice marker, and a second one in it; null without a marker."""
    _, once = tx.split_explicit_practice(content)
    _, twice = tx.split_explicit_practice(once)
    return F.coalesce(twice, once)


def practice_units(content: Column, theory_hours: Column, practice_hours: Column) -> Column:
    """The clauses of a content's practice (F12): after its marker, or all of it where the hours are practice alone; none for mixed hours without a marker."""
    own = F.when(F.coalesce(practice_hours, F.lit(0)) > 0, F.coalesce(practice_text(content), F.when(F.coalesce(theory_hours, F.lit(0)) == 0, content)))
    return F.when(F.trim(own) != "", tx.clause_units(own)).otherwise(F.array().cast("array<string>"))


def slot_units(units: Column, slot: Column, slots: Column) -> Column:
    """The units of one slot (from 0) when a list is dealt to ``slots`` slots in order: neighbouring shares, or, with fewer units than slots, each unit stretched and the surplus given to the last ones."""
    n = F.size(units)
    start = lambda k: F.floor(k * n / slots).cast("int")
    many = F.slice(units, start(slot) + 1, F.greatest(start(slot + 1) - start(slot), F.lit(0)))
    short, plain = F.floor(slots / n).cast("int"), (n - slots % n).cast("int")
    stretched = F.when(slot < plain * short, F.floor(slot / short)).otherwise(plain + F.floor((slot - plain * short) / (short + 1))).cast("int")
    return F.when((n == 0) | (slots <= 0), F.slice(units, 1, 0)).when(n >= slots, many).otherwise(F.slice(units, F.least(stretched + 1, n), F.lit(1)))


def slot_phrase(units: Column, continued: Column) -> Column:
    """A slot's units as one text, with the mark of continuation where the slot before had the same."""
    bare = F.filter(F.transform(units, lambda u: F.regexp_replace(tx.clean_spaces(u), r"[ .]+$", "")), lambda u: u != "")
    body = F.array_join(bare, ". ")
    return F.when(continued & (body != ""), F.concat(F.lit("Продолжение. "), body)).otherwise(body)


def dealt_practice(rows: DataFrame, topic: list[str], week: str) -> DataFrame:
    """Per appearance of a topic its share of the topic's practice (F15): the topic's columns, week, ``occurrence``, ``appearances`` and ``practice``.

    ``rows``: topic, week, content, theory_hours, practice_hours, and topic_title for topics that come up once: these get the clause that :func:`clauses.select_clauses` chooses. Of repeated ones every
    unit stands in the weeks once, in order. A week without practice hours, or with mixed hours and no marker, has an empty text.
    """
    counted = sequences.occurrences(rows, topic, [week])
    units = practice_units(F.col("content"), F.col("theory_hours"), F.col("practice_hours"))
    counted = counted.withColumn("units", units)
    k, n = F.col("occurrence").cast("int"), F.col("appearances").cast("int")
    share, before = slot_units(F.col("units"), k, n), slot_units(F.col("units"), k - 1, n)
    many = counted.where("appearances > 1").withColumn("practice", slot_phrase(share, (k > 0) & (share == before)))
    once = counted.where("appearances = 1")
    exploded = once.select(*topic, week, F.col("topic_title").alias("topic"), F.posexplode("units").alias("pos", "clause"), F.lit(None).cast("string").alias("theory_text"), F.lit(False).alias("theory_only"), F.lit(0).alias("occurrence"))
    chosen = clauses.select_clauses(exploded, [*topic, week], "pos").where("chosen").select(*topic, week, tx.clean_spaces(F.col("clause")).alias("practice"))
    one = once.join(chosen, [*topic, week], "left").withColumn("practice", F.coalesce("practice", F.lit("")))
    names = [*topic, week, "occurrence", "appearances", "practice"]
    return many.select(*names).unionByName(one.select(*names))


def theory_cell(number: Column, title: Column, content: Column, hours: Column) -> Column:
    """The theory cell of a week (F14): number, title, what stands before a practice marker inside the text, unless the title says it, and the hours; empty without hours."""
    label = F.concat(number, F.lit(". "), title)
    before = F.when(tx.practice_marker(content) == "split", tx.clean_spaces(F.get(F.split(content, tx.PRACTICE_ANYWHERE, 2), F.lit(0))))
    said = F.coalesce(before, F.lit(""))
    body = F.when((said != "") & ~F.contains(F.lower(label), F.lower(said)), F.concat(label, F.lit(". "), said)).otherwise(label)
    return F.when(F.coalesce(hours, F.lit(0)) <= 0, "").otherwise(F.concat(body, F.lit(" ("), hours.cast("string"), F.lit(")")))


def practice_summary(content: Column) -> Column:
    """What a content says of practice: the sentences after its first marker, else those that speak of practice; empty without."""
    kind = tx.practice_marker(content)
    after = F.when(kind == "block", F.get(F.split(content, tx.PRACTICE_BLOCK, 2), F.lit(1))).when(kind == "split", F.get(F.split(content, tx.PRACTICE_ANYWHERE, 2), F.lit(1)))
    marked = tx.clean_spaces(after)
    of = tx.joined_sentences(tx.sentences(marked))
    found = F.filter(tx.sentences(content), lambda s: F.regexp_like(s, F.lit(f"(?iuU){'|'.join(PRACTICE_STEMS)}")))
    return F.coalesce(F.when(kind.isNotNull(), F.when(of != "", of).otherwise(marked)).otherwise(tx.joined_sentences(found)), F.lit(""))


def practice_cell(number: Column, title: Column, content: Column, hours: Column, selected: Column) -> Column:
    """The practice cell of a week (F14): the selected clause, else the summary (under the title where it was split off inside the text and does not name it), else the title; empty without hours."""
    label = F.concat(number, F.lit(". "), title)
    summary = practice_summary(content)
    under = (tx.practice_marker(content) == "split") & ~F.contains(F.lower(summary), F.lower(title))
    clause = F.regexp_replace(tx.clean_spaces(F.coalesce(selected, F.lit(""))), r"[ .]+$", "")
    body = F.when(clause != "", clause).when(summary != "", F.when(F.coalesce(under, F.lit(False)), F.concat(label, F.lit(". "), summary)).otherwise(summary)).otherwise(label)
    return F.when(F.coalesce(hours, F.lit(0)) <= 0, "").otherwise(F.concat(body, F.lit(" ("), hours.cast("string"), F.lit(")")))


def topic_hours(parts: DataFrame, scope: list[str], topic: list[str]) -> DataFrame:
    """Adds ``topic_theory`` and ``topic_practice``, the hours of a topic over its scope: a whole plan, or one of its weeks (A5)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*scope, *topic)
    return parts.withColumns({f"topic_{c}": F.sum(F.coalesce(f"{c}_hours", F.lit(0))).over(w) for c in ("theory", "practice")})
