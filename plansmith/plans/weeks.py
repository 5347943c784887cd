"""Weeks put together from their parts: one form, one result and one control for each week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..staging import free_name

#: Forms of lessons that say nothing special, the form of both halves, and of each half.
MIXED = "теоретико-практическое занятие"
THEORY, PRACTICE, COMBINED = "теоретическое занятие", "практическое занятие", "комбинированное занятие"
GENERIC = [THEORY, PRACTICE, COMBINED]
#: Stems one of which a form must have, and signs that two forms were put side by side.
FORM_STEMS = r"заняти|практикум|экскурси|игр|тестирован|диагностик|тренинг|тренировк|творческ\w*\s+работ|соревнован|поход|прогул|бесед|викторин|конкурс|сл[её]т|семинар|лекци|мастер-класс|квест"
COMPOSED = r"(?:теори\w*|теоретическ\w*)\s*(?:и|/|\+)\s*(?:практик\w*|практическ\w*)"


def _is(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(f"(?iuU){pattern}"))


def is_single_form(x: Column) -> Column:
    """Whether a text names one form of lesson and not several (P33). Null is none."""
    tidy = F.lower(tx.clean_spaces(F.coalesce(x, F.lit(""))))
    several = F.size(F.filter(F.split(tidy, r"(?U)\s+и\s+"), lambda p: _is(p, FORM_STEMS))) > 1
    return (tidy != COMBINED) & ~F.regexp_like(tidy, F.lit(r"[+;|/,]")) & ~_is(tidy, COMPOSED) & ~several & _is(tidy, FORM_STEMS)


def final_form(candidate: Column, theory_hours: Column, practice_hours: Column) -> Column:
    """The candidate if it is one form, else the form of the hours."""
    by_hours = F.when((theory_hours > 0) & (practice_hours > 0), MIXED).when(practice_hours > 0, PRACTICE).otherwise(THEORY)
    return F.when(is_single_form(candidate), tx.clean_spaces(candidate)).otherwise(by_hours)


def week_forms(parts: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One form for each week from the forms of its parts, its hours and which halves have a text: keys, ``lesson_type``, theory_hours, practice_hours, n_parts.

    ``parts``: lesson_type, theory_hours, practice_hours, theory_text, practice_text. One grouping makes the set of forms, that of the parts with practice, the hours and the halves; a decision table reads
    them. Null hours count as none, null and blank texts and forms as missing.
    """
    form = F.nullif(F.trim("lesson_type"), F.lit(""))
    hours = {c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in ("theory_hours", "practice_hours")}
    has = {c: F.coalesce(F.bool_or(F.trim(c) != ""), F.lit(False)).alias(f"has_{c}") for c in ("theory_text", "practice_text")}
    rows = parts.groupBy(*keys).agg(
        F.array_sort(F.collect_set(form)).alias("forms"), F.array_sort(F.collect_set(F.when(F.col("practice_hours") > 0, form))).alias("practice_forms"),
        F.min_by(form, F.when(form.isNotNull(), F.col(pos))).alias("first_form"), F.min_by("lesson_type", pos).alias("leading"), F.count("*").alias("n_parts"), *hours.values(), *has.values(),
    )
    theory, practice = F.col("theory_hours") > 0, F.col("practice_hours") > 0
    only = F.when(F.size("forms") == 1, F.col("first_form"))
    special = lambda x: x.isNotNull() & ~x.isin(*GENERIC)
    of_practice = F.when(F.size("practice_forms") == 1, F.get("practice_forms", F.lit(0)))
    both = F.when(special(only), only).when(special(of_practice), of_practice).otherwise(MIXED)
    without_texts = F.when((F.col("n_parts") == 1) & (F.coalesce("leading", F.lit("")) != COMBINED), F.col("leading")).otherwise(MIXED)
    candidate = F.when(theory & ~practice, THEORY).when(practice & ~theory, F.when(special(only), only).otherwise(PRACTICE))
    candidate = candidate.when(theory & practice, F.when(F.col("has_theory_text") & F.col("has_practice_text"), both).otherwise(without_texts)).otherwise(F.coalesce(only, "leading"))
    return rows.select(*keys, final_form(candidate, F.col("theory_hours"), F.col("practice_hours")).alias("lesson_type"), "theory_hours", "practice_hours", "n_parts")


#: Fixed value: the pattern of a result's leading verb.
FINITE_VERB = r"[а-яё]+(?:ет|ит|ёт|ут|ют|ает|яет)"


def leading_verb(x: Column, verb: str = FINITE_VERB) -> Column:
    """The finite verb that a result begins with, in lower case, or null."""
    return F.lower(F.nullif(F.regexp_extract(F.trim(x), f"(?iuU)^({verb})(?![\\p{{L}}\\p{{N}}_])", 1), F.lit("")))


def without_verb(x: Column, verb: str = FINITE_VERB) -> Column:
    return tx.clean_spaces(F.regexp_replace(F.trim(x), f"(?iuU)^{verb}\\s+", ""))


def merged_results(results: Column, verb: str = FINITE_VERB, joint: str = " и ") -> Column:
    """A week's results, an array in order, as one text.

    Results from a safe template stay as they are, each once. Of phrases that hold each other the longer stays; if all begin with one verb it is said once and the objects are joined; else they are
    sentences one after the other. Without results the text is empty.
    """
    some = F.filter(results, lambda r: r.isNotNull() & (F.trim(r) != ""))
    safe = F.exists(some, lambda r: F.contains(r, F.lit(tx.SAFE_TEMPLATE)))

    def joined(unique: Column) -> Column:
        verbs = F.transform(unique, lambda r: leading_verb(r, verb))
        one_verb = (F.size(unique) > 1) & F.forall(verbs, lambda v: v.isNotNull()) & (F.size(F.array_distinct(verbs)) == 1)
        objects = F.filter(F.transform(unique, lambda r: F.regexp_replace(without_verb(r, verb), r"[ .]+$", "")), lambda r: r != "")
        own_verb = F.regexp_extract(F.get(unique, F.lit(0)), f"(?iuU)^({verb})", 1)
        said = F.concat_ws(" ", own_verb, F.nullif(tx.let(objects, lambda o: tx.joined_and(o, joint)), F.lit("")))
        sentences = F.array_join(F.transform(unique, lambda r: F.when(F.endswith(r, F.lit(".")), r).otherwise(F.concat(r, F.lit(".")))), " ")
        return F.when(F.size(unique) == 0, "").when(one_verb, tx.cap_sentence(said)).otherwise(tx.clean_spaces(sentences))

    return F.when(safe, F.array_join(F.array_distinct(some), " ")).otherwise(tx.let(tx.unique_phrases(some), joined))


def keep_strongest(rows: DataFrame, keys: list[str], pos: str, phrase: str, strength: Column, finite: Column) -> DataFrame:
    """Phrases of each group that stay beside its strongest (O6): keys, pos, phrase and ``strength``.

    While a group has ``finite`` phrases the others are no candidates. The strongest is that of the highest strength, the shortest of equal ones, the first of these. It and its finite siblings stay; but a
    group of one stays whole, and so does one of two unless exactly one candidate has strength 3 or more. A phrase that stands twice stays twice.
    """
    group = Window.partitionBy(*keys)
    names = {c: free_name(rows, c) for c in ("finite", "pool", "n", "threes", "best", "same")}
    c = {k: F.col(v) for k, v in names.items()}
    out = rows.select(*keys, pos, phrase, strength.cast("int").alias("strength"), F.coalesce(finite, F.lit(False)).alias(names["finite"]))
    out = out.withColumn(names["pool"], c["finite"] | ~F.max(c["finite"]).over(group))
    out = out.withColumns({names["n"]: F.count("*").over(group), names["threes"]: F.sum((c["pool"] & (F.col("strength") >= 3)).cast("int")).over(group)})
    out = out.withColumn(names["best"], F.row_number().over(group.orderBy(c["pool"].desc(), F.col("strength").desc(), F.length(phrase), pos)) == 1)
    out = out.withColumn(names["same"], F.col(phrase) == F.max(F.when(c["best"], F.col(phrase))).over(group))
    whole = (c["n"] < 2) | ((c["n"] < 3) & (c["threes"] != 1))
    return out.where(whole | c["same"] | c["finite"]).drop(*names.values())


def merge_weeks(parts: DataFrame, keys: list[str], pos: str, verb: str = FINITE_VERB, joint: str = " и ") -> DataFrame:
    """One row a week: the form of :func:`week_forms`, ``result`` and ``control`` of its parts put together.

    ``parts`` has in addition to what week_forms reads: result, control. A week of one part keeps its own texts.
    """
    listed = parts.groupBy(*keys).agg(*[F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(F.col(c), F.lit("")).alias("t")))).alias(c) for c in ("result", "control")])
    texts = {c: F.transform(c, lambda x: x["t"]) for c in ("result", "control")}
    one = F.size("result") == 1
    own = {c: F.get(texts[c], F.lit(0)) for c in texts}
    merged = listed.select(*keys, F.when(one, own["result"]).otherwise(merged_results(texts["result"], verb, joint)).alias("result"), F.when(one, own["control"]).otherwise(tx.merged_controls(texts["control"])).alias("control"))
    return week_forms(parts, keys, pos).join(merged, keys)
