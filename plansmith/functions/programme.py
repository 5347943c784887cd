"""Facts of an educational programme from its phrases, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import academic_year
from .text import clean_spaces

#: Stems of ordinals by the year that they name.
YEAR_STEMS = {"перв": 1, "втор": 2, "трет": 3, "четв": 4}


def duration_years(x: Column) -> Column:
    """The years that a duration states at its start ("2 года", "3 года обучения"); null for ranges, words and anything else."""
    n = F.regexp_extract(x, r"(?iuU)^\s*(\d+)\s+(?:год(?:а|ов)?|лет)\b", 1).try_cast("int")
    return F.when(n > 0, n)


def age_range(x: Column) -> Column:
    """(low, high) of "N–M лет" or "от N до M", with 0 < low <= high <= 80; else null."""
    dash, words = r"(?iuU)\b(\d{1,2})\s*[-–—]\s*(\d{1,2})\b(?!\d)", r"(?iuU)от\s+(\d{1,2})\s+до\s+(\d{1,2})"
    by_words = F.regexp_like(x, F.lit(words))
    low = F.when(by_words, F.regexp_extract(x, words, 1)).otherwise(F.regexp_extract(x, dash, 1)).try_cast("int")
    high = F.when(by_words, F.regexp_extract(x, words, 2)).otherwise(F.regexp_extract(x, dash, 2)).try_cast("int")
    return F.when((low > 0) & (low <= high) & (high <= 80), F.struct(low.alias("low"), high.alias("high")))


def study_year_number(x: Column) -> Column:
    """The study year as a number: by the stem of an ordinal, else the first digits; null without either."""
    out = F.regexp_extract(x, r"(\d+)", 1).try_cast("int")
    for stem, n in reversed(YEAR_STEMS.items()):
        out = F.when(F.contains(F.lower(x), F.lit(stem)), n).otherwise(out)
    return out


def study_year_label(x: Column) -> Column:
    """"N год обучения", or the phrase itself with "год обучения" where it names no number; null for nothing."""
    text, n = clean_spaces(x), study_year_number(x)
    return F.when(n.isNotNull(), F.concat(n.cast("string"), F.lit(" год обучения"))).when(text != "", F.concat(text, F.lit(" год обучения")))


def academic_year_mentions(x: Column) -> Column:
    """The academic years named on lines that speak of a study year, in order and distinct."""
    lines = F.filter(F.split(x, "\n"), lambda s: F.regexp_like(s, F.lit(r"(?iuU)учебн\w*\s+год")))
    found = F.flatten(F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit(r"(\d{4}\s*[-–—/]\s*\d{2,4})"), 1)))
    return F.array_distinct(F.array_compact(F.transform(found, academic_year)))


def resolve_academic_year(plan: Column, programme: Column) -> Column:
    """(status, academic_year) from the mentions of both sources: auto if both name one same year, single if one does, conflict, or missing."""
    years = F.array_union(plan, programme)
    both = (F.size(plan) > 0) & (F.size(programme) > 0)
    status = F.when(F.size(years) == 0, "missing").when(F.size(years) > 1, "conflict").when(both, "auto").otherwise("single")
    return F.struct(status.alias("status"), F.when(F.size(years) == 1, F.get(years, F.lit(0))).alias("academic_year"))


def attestation_statements(x: Column) -> Column:
    """The lines that speak of an attestation, cleaned, in order and distinct."""
    return F.array_distinct(F.transform(F.filter(F.split(x, "\n"), lambda s: F.contains(F.lower(s), F.lit("аттестац"))), clean_spaces))


def outcome_items(x: Column) -> Column:
    """The single outcomes of a list in prose: parted by semicolons and line ends, without bullets and end marks."""
    parts = F.transform(F.split(x, r"[;\n]"), lambda s: F.regexp_replace(clean_spaces(s), r"^[-–—•·*\s]+|[\s.;]+$", ""))
    return F.array_distinct(F.filter(parts, lambda s: s != ""))
