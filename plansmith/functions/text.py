"""Text functions as column expressions. Patterns carry (?iuU): Java's classes are ASCII without it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations whose dot ends no clause.
ABBREVIATIONS = ["г", "ул", "пр", "пер", "обл", "р-н", "с", "п", "д", "пос", "т", "пгт"]
_MARK, _CUT = "\u0001", "\u0002"


def clean_spaces(x: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def first_capture(x: Column, pattern: str) -> Column:
    """The first group of the first match whatever the case, or null."""
    return F.nullif(F.regexp_extract(x, f"(?iuU){pattern}", 1), F.lit(""))


def lenient_integer(x: Column) -> Column:
    """The first run of digits as an integer; blanks, dashes and other text are 0."""
    return F.coalesce(F.regexp_substr(x, F.lit(r"\d+")).try_cast("int"), F.lit(0))


def number_and_title(x: Column) -> tuple[Column, Column]:
    """The leading section number (null without one) and the rest of a title."""
    clean = clean_spaces(x)
    number = F.nullif(F.regexp_extract(clean, r"^(\d+(?:\.\d+)*)\.?\s*\S", 1), F.lit(""))
    title = F.when(number.isNotNull(), F.regexp_replace(clean, r"^\d+(?:\.\d+)*\.?\s*", "")).otherwise(clean)
    return number, title


def normalise_title(x: Column) -> Column:
    """Lower case, ё as е, other characters than Latin and Cyrillic letters and digits as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), "ё", "е"), "[^a-zа-я0-9]+", " "))


def preview(x: Column, size: int = 320) -> Column:
    """The text, or its first size - 1 characters and an ellipsis."""
    return F.when(F.length(x) <= size, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, size - 1)), F.lit("…")))


def clause_units(x: Column) -> Column:
    """Clauses of a text: parted after . ! ? and white space, at line ends and semicolons, dots of abbreviations apart."""
    protected = F.regexp_replace(x, rf"(?iuU)\b(?=[г-уГ-У])({'|'.join(ABBREVIATIONS)})\.(\s*)", f"$1{_MARK}$2")
    cut = F.regexp_replace(F.regexp_replace(protected, r"(?U)([.!;?])\s+", f"$1{_CUT}"), r"[\n;]", _CUT)
    parts = F.split(F.regexp_replace(cut, r"(?U)\s+", " "), _CUT)
    tidy = F.transform(parts, lambda p: F.btrim(F.replace(p, F.lit(_MARK), F.lit(".")), F.lit(" .;:")))
    return F.filter(tidy, lambda p: p != "")


def split_at_marker(x: Column, marker: str) -> tuple[Column, Column]:
    """The text before the first marker and after it; without one all is before and null after."""
    at = F.locate(marker, x)
    return F.when(at > 0, F.rtrim(F.substr(x, F.lit(1), at - 1))).otherwise(x), F.when(at > 0, F.ltrim(F.substr(x, at + len(marker))))


#: Forms after one, two and five.
HOURS, WEEKS = ("час", "часа", "часов"), ("неделя", "недели", "недель")


def counted_word(n: Column, forms: tuple[str, str, str] = HOURS) -> Column:
    """The Russian form of a word after a number."""
    ten, hundred = n % 10, n % 100
    return F.when((ten == 1) & (hundred != 11), forms[0]).when(ten.between(2, 4) & ~hundred.between(12, 14), forms[1]).otherwise(forms[2])


def hours_word(n: Column) -> Column:
    """The Russian word for so many hours."""
    return counted_word(n)


def short_hours_word(n: Column) -> Column:
    """The form used in documents, which knows 1 and 2 to 4 alone."""
    return F.when(n == 1, HOURS[0]).when(n.between(2, 4), HOURS[1]).otherwise(HOURS[2])


def programme_number_and_title(x: Column) -> tuple[Column, Column]:
    """As :func:`number_and_title`, but white space must part the number from a text."""
    clean = clean_spaces(x)
    number = F.nullif(F.regexp_extract(clean, r"^(\d+(?:\.\d+)*)\.?\s+.", 1), F.lit(""))
    return number, F.when(number.isNotNull(), F.regexp_replace(clean, r"^\d+(?:\.\d+)*\.?\s+", "")).otherwise(clean)


#: The markers that open the practice part, at the start of a line or, the first, anywhere.
PRACTICE_AT_LINE, PRACTICE_BLOCK, PRACTICE_ANYWHERE = r"(?iuU)(?:^|\n)\s*(?:Практика\.|Практические занятия\.?)\s*", r"(?iuU)(?:^|\n)\s*Практические занятия\.?\s*", r"(?iuU)\bПрактика\.\s*"


def split_explicit_practice(x: Column) -> tuple[Column, Column]:
    """Theory and practice parted by the first marker at a line's start; nulls without one."""
    parts = F.split(x, PRACTICE_AT_LINE, 2)
    found = F.size(parts) == 2
    return F.when(found, F.regexp_replace(parts[0], r"(?U)^\s+|\s+$", "")), F.when(found, F.regexp_replace(F.get(parts, F.lit(1)), r"(?U)^\s+|\s+$", ""))


def practice_marker(x: Column) -> Column:
    """Which display marker comes first: "block" at a line's start or "split" anywhere; null without one."""
    at = lambda p: F.nullif(F.regexp_instr(x, F.lit(p)), F.lit(0))
    block, split = at(PRACTICE_BLOCK), at(PRACTICE_ANYWHERE)
    return F.when(block.isNull() & split.isNull(), F.lit(None)).when(split.isNull() | (block <= split), "block").otherwise("split")


def sentences(x: Column) -> Column:
    """Sentences of a text: parted after . ! ? and white space."""
    return F.filter(F.split(clean_spaces(x), r"(?<=[.!?])\s+"), lambda p: p != "")


def joined_sentences(parts: Column) -> Column:
    """Sentences without their last dots, joined by dots."""
    bare = F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"\.+$", ""))
    return F.array_join(F.filter(bare, lambda p: p != ""), ". ")


def cap_sentence(x: Column) -> Column:
    """A first capital and a last dot; an abbreviation's dot is not the sentence's."""
    clean = clean_spaces(x)
    dot = F.regexp_like(clean, F.lit(r"(?iuU)\b(?:г|ул|пр|пер|обл|р-н)\.$")) | ~F.substring(clean, -1, 1).isin(".", "!", "?")
    return F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 1 << 30), F.when(dot | (clean == ""), ".").otherwise(""))


def output_filename(name: Column, year: Column) -> Column:
    """A file name from a programme's name and its academic year."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("программа")), r'(?U)[<>:"/\\|?*\s]+', "_"), "^_+|_+$", "")
    return F.concat(F.lit("Календарный_план_"), F.when(safe == "", "календарь").otherwise(safe), F.lit("_"), F.replace(year, F.lit("–"), F.lit("-")), F.lit(".docx"))


def first_of_list(items: Column, most: int = 8) -> Column:
    """A list for a message: at most so many items, and an ellipsis if there are more."""
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, "…").otherwise(""))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(x), lambda v: body(v)), F.lit(0))


def unique_phrases(phrases: Column) -> Column:
    """Phrases in order without those that are equal to or part of another; a longer later one takes the place of the first shorter one.

    Case, spaces and last dots don't count.
    """
    tidy = F.transform(F.transform(phrases, clean_spaces), lambda p: F.struct(p.alias("text"), F.lower(F.regexp_replace(p, r"[ .]+$", "")).alias("bare")))

    def put(kept: Column, p: Column, hit: Column) -> Column:
        swapped = F.transform(kept, lambda k, i: F.when((i == hit - 1) & ~F.contains(k["bare"], p["bare"]), p).otherwise(k))
        return F.when(hit == 0, F.concat(kept, F.array(p))).otherwise(swapped)

    def step(kept: Column, p: Column) -> Column:
        equal = F.exists(kept, lambda k: k["bare"] == p["bare"])
        near = F.transform(kept, lambda k: F.contains(k["bare"], p["bare"]) | F.contains(p["bare"], k["bare"]))
        return F.when(equal | (p["bare"] == "") | p["bare"].isNull(), kept).otherwise(let(F.array_position(near, F.lit(True)), lambda hit: put(kept, p, hit)))

    none = F.array().cast("array<struct<text: string, bare: string>>")
    return F.transform(F.aggregate(tidy, none, step), lambda k: k["text"])


#: Openings that controls of one week may share, and the mark of a safe template.
CONTROL_PREFIXES = ["устный опрос по ", "практическое задание по ", "педагогическое наблюдение за ", "педагогическое наблюдение ", "проверка "]
SAFE_TEMPLATE = "по теме „"


def joined_and(parts: Column, joint: str = " и ") -> Column:
    """Parts without their last dots, joined by commas and, before the last, a word."""
    bare = F.filter(F.transform(parts, lambda p: F.regexp_replace(clean_spaces(p), r"[ .]+$", "")), lambda p: p != "")
    n = F.size(bare)
    return F.when(n < 2, F.array_join(bare, "")).otherwise(F.concat(F.array_join(F.slice(bare, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(joint), F.element_at(bare, -1)))


def merged_controls(controls: Column) -> Column:
    """A week's controls as one text: distinct ones joined by "; ", or one shared opening and its ends."""
    safe = F.exists(controls, lambda c: F.contains(c, F.lit(SAFE_TEMPLATE)))
    as_they_are = F.array_join(F.array_distinct(F.filter(controls, lambda c: c != "")), "; ")

    def joined(unique: Column) -> Column:
        out = F.when(F.size(unique) < 2, F.array_join(unique, ""))
        for prefix in CONTROL_PREFIXES:
            out = out.when(*_shared_opening(unique, prefix))
        return out.otherwise(F.array_join(unique, "; "))

    return F.when(safe, as_they_are).otherwise(let(unique_phrases(controls), joined))


def _shared_opening(phrases: Column, prefix: str) -> tuple[Column, Column]:
    """Whether all phrases open so, and one text of the opening and their ends."""
    ends = F.transform(phrases, lambda c: F.trim(F.substring(c, len(prefix) + 1, 1 << 30)))
    return F.forall(phrases, lambda c: F.startswith(F.lower(c), F.lit(prefix))), F.concat(F.lit(prefix), let(unique_phrases(ends), joined_and))


def round_robin(items: Column, occurrence: Column) -> Column:
    """The item that is this occurrence's turn."""
    return F.when(F.size(items) > 0, F.get(items, (occurrence % F.size(items)).cast("int")))


def slot_text(parts: Column, continued: Column) -> Column:
    """A slot's units as one text, with the continuation prefix where the slot goes on with the last one's unit."""
    text = F.array_join(parts, " ")
    return F.when(continued & (text != ""), F.concat(F.lit("Продолжение. "), text)).otherwise(text)


#: A place that a shortened phrase may end after, what may follow it, abbreviations and marks that no phrase ends with, and how far past the limit a place may lie.
PLACE, MORE_PLACES = r"\bг\.\s*[А-ЯЁA-Z][\w\-]*(?:\s+[А-ЯЁA-Z][\w\-]*)*", r"(?:\s+и\s+[А-ЯЁа-яёA-Za-z\-]+)*"
UNFINISHED = r"(?iuU)(?:\b(?:г|ул|пр|пер|обл|р-н|респ)\.\s*|[«(\-—])$"
SEPARATORS, LEAST_LEFT, PLACE_PAST, MORE_PAST = [";", ", ", " — ", " - "], 24, 40, 60


def clean_phrase(x: Column) -> Column:
    """Single spaces, no marks at the ends and no dots of omission in front."""
    tidy = F.btrim(clean_spaces(x), F.lit(" .;:"))
    return F.regexp_replace(F.trim(F.regexp_replace(tidy, r"^[….]+", "")), r"^:\s*", "")


def shortened(x: Column, most: int = 220, place: str = PLACE, more: str = MORE_PLACES) -> Column:
    """A phrase of at most about ``most`` characters, cut from its end at a safe place; the whole phrase where there is none (F16).

    Places in order: after the first place name, with others joined to it, if that ends a little past the limit at most; else the last semicolon, comma, long or short dash before the limit that leaves
    enough. No cut leaves an abbreviation, an open bracket or a dash at the end, or begins with dots.
    """

    def cut(text: Column) -> Column:
        sound = lambda c: ~F.regexp_like(c, F.lit(UNFINISHED)) & ~F.startswith(c, F.lit("…")) & ~F.startswith(c, F.lit("..."))
        bare = lambda c: F.btrim(c, F.lit(" .;"))
        named, whole = (F.regexp_extract(text, f"(?suU)^(.*?{p})", 1) for p in (place, place + more))
        near = (named != "") & (F.length(named) <= most + PLACE_PAST) & (F.length(whole) <= most + MORE_PAST) & sound(bare(whole))
        out = F.when(F.length(text) <= most, text).when(near, bare(whole))
        head = F.substring(text, 1, most + 1)
        for sep in SEPARATORS:
            left = bare(F.substr(head, F.lit(1), F.length(head) - F.length(F.substring_index(head, sep, -1)) - len(sep)))
            out = out.when(F.contains(head, F.lit(sep)) & (F.length(left) >= LEAST_LEFT) & sound(left), left)
        return out.otherwise(text)

    return let(clean_phrase(x), cut)
