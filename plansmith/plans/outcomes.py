"""Which stated outcome fits a lesson best: an inverted index of word roots, whole-number scores, and a pick from the band at the top.

Outcomes and topics of a plan meet only in a root that both have, each in a row of its own: a grouping of these meetings gives the numbers of shared roots of every pair that
shares any. No topic is paired with all outcomes. What a pair can still gain from its texts is bounded by the lengths of its word lists, so
pairs that can't reach the least score go before any text is looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that carry no topic, for titles and for outcomes.
TITLE_STOP = ["и", "или", "для", "при", "по", "на", "в", "во", "с", "со", "о", "об", "его", "их", "the", "основы", "основн", "правила", "общие", "сведен"]
OUTCOME_STOP = [*TITLE_STOP[:14], "это", "как", "что", "все", *TITLE_STOP[15:], "основные", "должны", "знать", "уметь"]
#: Roots that too many topics share, and words whose root is not their first six letters.
GENERIC_ROOTS = ["турист", "поход", "занят", "обучен", "програм", "правил", "основ", "общие", "сведен", "личн", "групп", "детск", "воспита", "умения", "знани", "навык", "местност", "места", "место", "движе", "выбор", "требо", "основн", "подго", "истор"]
SPECIAL_ROOTS = {"организм": "организм", "организа": "организац", "лыж": "лыж"}


@dataclass(frozen=True)
class Lexicon:
    """The words of a language that scores rest on. ``word`` and ``place`` are patterns of lower-case text; ``inner`` holds the characters after which no word begins, as in brackets of a pattern."""

    word: str = "[а-яё]{4,}"
    inner: str = r"\w"
    place: str = r"(?:^|[^а-яёa-z0-9_])г\.\s*[а-яёa-z0-9_]"
    title_stop: list[str] = field(default_factory=lambda: TITLE_STOP)
    outcome_stop: list[str] = field(default_factory=lambda: OUTCOME_STOP)
    generic: list[str] = field(default_factory=lambda: GENERIC_ROOTS)
    special: dict[str, str] = field(default_factory=lambda: SPECIAL_ROOTS)


#: Points of a shared root by where the lesson has it, the least score, and the width of the band.
TITLE, CONTENT, ACTIVITY, PRIMARY = 12, 11, 7, 3
LEAST, BAND = 16, 3
ROOT = 6


def words_of(x: Column, stop: list[str], lexicon: Lexicon) -> Column:
    """The distinct words of a text in lower case that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(f"({lexicon.word})"))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*stop)) if stop else found)


def root_of(word: Column, lexicon: Lexicon) -> Column:
    """A word's first six letters, or its special root."""
    out = F.substring(word, 1, ROOT)
    for start, root in reversed(lexicon.special.items()):
        out = F.when(F.startswith(word, F.lit(start)), root).otherwise(out)
    return out


def is_generic(root: Column, lexicon: Lexicon) -> Column:
    out = F.lit(False)
    for stem in lexicon.generic:
        out = out | F.startswith(root, F.lit(stem[:5])) | F.startswith(F.lit(stem), root)
    return out


def distinctive_roots(x: Column, lexicon: Lexicon) -> Column:
    """The roots of a text's words without the generic ones."""
    roots = F.array_distinct(F.transform(words_of(x, lexicon.outcome_stop, lexicon), lambda w: root_of(w, lexicon)))
    return F.filter(roots, lambda r: ~is_generic(r, lexicon))


def prefix_hits(words: Column, text: Column) -> Column:
    """How many words have their first four letters somewhere in the text, whatever the case."""
    return F.size(F.filter(words, lambda w: F.contains(F.lower(text), F.substring(w, 1, 4))))


def words_inside(words: Column, text: Column) -> Column:
    """How many words stand in the text, inside longer words too."""
    return F.size(F.filter(words, lambda w: F.contains(F.lower(text), w)))


def has_place(x: Column, lexicon: Lexicon) -> Column:
    return F.regexp_like(F.lower(F.coalesce(x, F.lit(""))), F.lit(f"(?U){lexicon.place}"))


def match_score(title: Column, content: Column, activity: Column, prefixes: Column, overlap: Column, both_places: Column, theory_only: Column, length: Column) -> Column:
    """An outcome's points for a lesson, from numbers of shared roots and words.

    Without a root of the title, two of the content and activity or three prefixes are asked for.
    """
    bare = title == 0
    weak = bare & (((content + activity < 2) & (prefixes < 3)) | (content + activity == 0))
    points = title * TITLE + content * CONTENT + activity * ACTIVITY + prefixes + overlap * 2
    points = points + F.when(title >= 2, 45).when(title == 1, 12).otherwise(-8) + F.when(both_places, 5).otherwise(0)
    points = points - F.when(bare & theory_only, 16).otherwise(0) - F.when(length > 180, 2).otherwise(0)
    return F.when(weak, -50).otherwise(points).cast("int")


def shared_roots(topics: DataFrame, outcomes: DataFrame, plan: list[str], topic: list[str], outcome: list[str]) -> DataFrame:
    """Pairs of a plan's topics and outcomes that share a root, and how many of the title, content and activity they share.

    ``topics`` has arrays of roots title_roots, content_roots and activity_roots, ``outcomes`` has roots. Each root is a row on either side, and a pair is found by grouping
    the rows in which it meets.
    """
    every = F.array_union(F.array_union("title_roots", "content_roots"), "activity_roots")
    places = topics.select(*plan, *topic, F.explode(every).alias("root"), "title_roots", "content_roots", "activity_roots")
    flags = [F.array_contains(f"{c}_roots", F.col("root")).cast("int").alias(c) for c in ("title", "content", "activity")]
    index = outcomes.select(*plan, *outcome, F.explode("roots").alias("root"))
    met = places.select(*plan, *topic, "root", *flags).join(index, [*plan, "root"])
    return met.groupBy(*plan, *topic, *outcome).agg(*[F.sum(c).cast("int").alias(c) for c in ("title", "content", "activity")])


def scored_outcomes(topics: DataFrame, outcomes: DataFrame, plan: list[str], lexicon: Lexicon | None = None, least: int = LEAST) -> DataFrame:
    """Pairs of topics and outcomes of a plan with at least ``least`` points.

    ``topics``: plan, topic_id, topic, content, activity, theory_hours, practice_hours, occurrence; ``outcomes``: plan, kind ('knowledge' or 'skill'), pos and outcome.
    A lesson's first kind is skill where practice leads or equals theory, else knowledge; outcomes of it gain three points. Null texts count as empty; blank outcomes are left out; an outcome
    that is stated as both kinds is of both.
    """
    lexicon = lexicon or Lexicon()
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    lessons = topics.select(
        *plan, "topic_id", "occurrence", text("topic").alias("topic"), text("content").alias("content"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("theory_hours", "practice_hours")],
        *[distinctive_roots(F.col(c), lexicon).alias(f"{a}_roots") for c, a in (("topic", "title"), ("content", "content"), ("activity", "activity"))], words_of(F.col("topic"), lexicon.title_stop, lexicon).alias("title_words"),
    )
    of_text = Window.partitionBy(*plan, "outcome")
    stated = outcomes.where(F.trim("outcome") != "").select(*plan, "kind", "pos", "outcome").withColumns({k: F.max(F.col("kind") == k).over(of_text) for k in ("knowledge", "skill")})
    stated = stated.withColumns({"roots": distinctive_roots(F.col("outcome"), lexicon), "outcome_words": words_of(F.col("outcome"), lexicon.outcome_stop, lexicon)})
    pairs = shared_roots(lessons, stated, plan, ["topic_id"], ["kind", "pos"])
    pairs = pairs.join(stated.drop("roots"), [*plan, "kind", "pos"])
    slim = lessons.select(*plan, "topic_id", "theory_hours", "practice_hours", F.size("title_words").alias("n_title_words"))
    theory, practice = F.col("theory_hours") > 0, F.col("practice_hours") > 0
    skills_first = practice & (~theory | (F.col("practice_hours") >= F.col("theory_hours")))
    first_kind = F.when(skills_first, F.col("skill")).when(practice | theory, F.col("knowledge")).otherwise(F.col("skill"))
    most = match_score(F.col("title"), F.col("content"), F.col("activity"), F.size("outcome_words"), F.col("n_title_words"), F.lit(True), theory & ~practice, F.length("outcome"))
    possible = pairs.join(slim, [*plan, "topic_id"]).where(most + F.when(first_kind, PRIMARY).otherwise(0) >= least)
    j = possible.join(lessons.select(*plan, "topic_id", "occurrence", F.col("topic").alias("topic_text"), F.col("content").alias("content_text"), "title_words"), [*plan, "topic_id"])
    places = has_place(F.col("outcome"), lexicon) & has_place(F.concat("topic_text", F.lit("\n"), "content_text"), lexicon)
    points = match_score(F.col("title"), F.col("content"), F.col("activity"), prefix_hits(F.col("outcome_words"), F.col("content_text")), words_inside(F.col("title_words"), F.col("outcome")), places, theory & ~practice, F.length("outcome"))
    j = j.withColumn("score", points + F.when(first_kind, PRIMARY).otherwise(0)).where(F.col("score") >= least)
    return j.select(*plan, "topic_id", "occurrence", "theory_hours", "practice_hours", "kind", "pos", "outcome", "knowledge", "skill", F.col("title").alias("title_hits"), "score")


def choose_outcomes(topics: DataFrame, outcomes: DataFrame, plan: list[str], lexicon: Lexicon | None = None, least: int = LEAST, band: int = BAND) -> DataFrame:
    """Per topic the outcome whose turn it is among the best: plan, topic_id, outcome, score, title_hits and ``n_best``, how many lie in the band.

    Outcomes that share a root of the title go before all others, and among these, for a lesson of theory or of practice alone, those of its kind. The band is ``band`` points
    below the best and one root of the title; ``occurrence`` counts around it. Topics without an outcome give no row.
    """
    rows = scored_outcomes(topics, outcomes, plan, lexicon, least)
    of_topic = Window.partitionBy(*plan, "topic_id")
    titled = F.col("title_hits") > 0
    theory, practice = F.col("theory_hours") > 0, F.col("practice_hours") > 0
    fits = titled & ((theory & ~practice & F.col("knowledge")) | (practice & ~theory & F.col("skill")))
    pool = F.when(fits, 2).when(titled, 1).otherwise(0)
    rows = rows.withColumn("pool", pool).withColumn("best_pool", F.max("pool").over(of_topic)).where("pool = best_pool")
    order = of_topic.orderBy(F.col("score").desc(), F.col("title_hits").desc(), "outcome", "kind", "pos")
    rows = rows.withColumns({"top_score": F.first("score").over(order), "top_hits": F.first("title_hits").over(order)})
    near = rows.where((F.col("score") >= F.col("top_score") - band) & (F.col("title_hits") >= F.greatest(F.lit(0), F.col("top_hits") - 1)))
    near = near.withColumns({"turn": F.row_number().over(order) - 1, "n_best": F.count("*").over(of_topic)})
    return near.where(F.col("turn") == F.pmod(F.coalesce("occurrence", F.lit(0)), "n_best")).select(*plan, "topic_id", "outcome", "kind", "score", "title_hits", "n_best")


#: Starts of words that show something to do, openings in the abstract, and two openings with points of their own.
ACTION_STEMS = ["выбор", "подбор", "подготовк", "составлен", "составля", "разработ", "определен", "организац", "распредел", "провер", "изучен", "анализ", "работа", "измерен", "ориентир", "укладк", "развертыван", "свертыван", "преодолен", "наблюден", "отработк", "рассчит", "представлен", "изготовлен", "применен", "выполнен", "аппликац", "конструир", "рисунк", "рассказ", "заслушиван", "разжиган", "построен", "упражнен", "знакомств", "прогул", "экскурси", "викторин"]
ABSTRACT_OPENINGS = ["понятие", "значение", "характеристика", "роль государства", "виды туризма", "требования к", "разрядн", "основная задача", "роль и значение"]
EVENT_OPENING, TRIP_OPENING = "мероприятие", "экскурси"


def fragment_score(fragment: Column, title: Column, lexicon: Lexicon | None = None, actions: list[str] | None = None, abstract: list[str] | None = None) -> Column:
    """How much a fragment reads like something to do (F19): hints of action, questions, openings, places, words of the title and length."""
    lexicon = lexicon or Lexicon()
    low, n = F.lower(fragment), F.length(fragment)
    acts, opens = (f"(?U)(?:^|[^{lexicon.inner}])(?:{'|'.join(actions or ACTION_STEMS)})", f"(?U)^(?:{'|'.join(abstract or ABSTRACT_OPENINGS)})")
    questions = F.length(fragment) - F.length(F.replace(fragment, F.lit("?"), F.lit("")))
    points = F.when(F.regexp_like(low, F.lit(acts)), 6).otherwise(0) - F.when(F.regexp_like(low, F.lit(opens)), 6).otherwise(0)
    points = points - F.when(questions >= 2, 7).when(questions == 1, 3).otherwise(0)
    points = points + F.when(F.startswith(low, F.lit(EVENT_OPENING)) | F.contains(fragment, F.lit("«")), 5).otherwise(0) - F.when(F.startswith(low, F.lit(TRIP_OPENING)), 1).otherwise(0)
    points = points + F.when(has_place(fragment, lexicon), 3).otherwise(0) + 3 * words_inside(words_of(title, lexicon.title_stop, lexicon), fragment)
    return (points + F.when(n.between(25, 140), 4).when(n.between(141, 200), 1).when(n > 200, -2).when(n < 18, -2).otherwise(0)).cast("int")


def best_fragments(rows: DataFrame, keys: list[str], pos: str, fragment: str, score: str) -> DataFrame:
    """Per key the fragment with the most points, the first among equal ones."""
    best = F.max_by(F.struct(fragment, score, pos), F.struct(F.col(score), -F.col(pos)))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*keys, f"best.{fragment}", f"best.{score}", f"best.{pos}")
