"""Clauses of a lesson's text: their features, the choice of one, its neighbours, and clauses that only go on with the one before.

Rules are tables of patterns (data); each operator applies a table in one pass over the rows and orders them by windows of a lesson.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import free_name


def _is(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(f"(?iuU){pattern}"))


#: Stems of heads that mean doing and making, nouns that open knowledge, and stems of topics that say nothing.
PERFORM_STEMS = ["укладк", "разжиган", "развертыван", "свертыван", "оказан", "установ", "отработк", "упражнен"]
PRODUCE_STEMS = ["составлен", "изготовлен", "разработ", "рисован", "разучиван", "решен", "подготовк"]
KNOWLEDGE_NOUNS = ["история", "организация", "понятие", "значение", "роль", "сведения", "характеристика", "виды", "биография"]
GENERIC_TOPIC_STEMS = ["техник", "занят", "проведен", "поход", "турист", "основ", "правил", "занятий", "физическ", "специальн", "сведен", "влияни"]
#: What makes a clause specific, and its weight.
SPECIFIC = [("план-график", 3), ("плана-график", 3), ("меню", 2), ("рюкзак", 2), ("костр", 2), ("бивак", 2), ("аптечк", 2), ("маршрут", 1)]


@dataclass(frozen=True)
class ClassRule:
    """A rule of the class table: the pattern, the part of a clause that it reads, the class, and whether it holds in theory, in practice or in both."""

    part: str
    pattern: str
    action_class: int
    theory: bool | None = None


def _starts(stems: list[str]) -> str:
    return f"^(?:{'|'.join(stems)})"


def _inside(stems: list[str]) -> str:
    return "|".join(stems)


_VERBAL = r"(?:ание|ение|тие|ка|овка)$"
#: The class table in order of precedence; the first rule that holds gives the class, none gives 1.
CLASS_RULES = [
    ClassRule("clause", r"(?:влияни\w*|воздействи\w*|процесс\w*)\s", 0),
    ClassRule("first", f"^(?:{'|'.join(KNOWLEDGE_NOUNS)})$", 1, True),
    ClassRule("first", r"^(?:виды|понятие)$", 1, True),
    ClassRule("first", _starts(["разрядн", "понятие", "значение", "характеристика", "роль", "виды", "требования", "способ"]), 0),
    ClassRule("first", _VERBAL, 1, True),
    ClassRule("first", r"^(?:прогул\w*|упражнен\w*|игр[аы]|эстафет\w*|викторин\w*)$", 3),
    ClassRule("lead", _inside([*PERFORM_STEMS, *PRODUCE_STEMS, "ориентир", "измерен"]), 3),
    ClassRule("first", _starts(["определен", "изучен", "знакомств", "поняти", "значен", "соблюден"]), 0),
    ClassRule("first", _VERBAL, 2),
]


@dataclass(frozen=True)
class ClauseRules:
    """What clause features rest on: the class table, patterns of words and places, and weights of what is specific."""

    classes: list[ClassRule] = field(default_factory=lambda: CLASS_RULES)
    word: str = "[а-яё]{4,}"
    place: str = r"\bг\.\s*[а-яёa-z]"
    generic: list[str] = field(default_factory=lambda: GENERIC_TOPIC_STEMS)
    specific: list[tuple[str, int]] = field(default_factory=lambda: SPECIFIC)


def action_class(clause: Column, theory_only: Column, rules: list[ClassRule]) -> Column:
    """The class of the first rule of the table that holds, 1 without one."""
    words = F.split(F.trim(clause), r"\s+")
    parts = {"clause": clause, "first": F.element_at(words, 1), "lead": F.array_join(F.slice(words, 1, 3), " ")}
    out = F.lit(1)
    for r in reversed(rules):
        holds = _is(parts[r.part], r.pattern)
        if r.theory is not None:
            holds = holds & (theory_only if r.theory else ~theory_only)
        out = F.when(holds, r.action_class).otherwise(out)
    return out


def topic_hits(clause: Column, topic: Column, rules: ClauseRules) -> Column:
    """How far a clause speaks of a topic: each of the topic's words that it has, whole or by its stem, counts two from eight letters on and one below."""
    words = lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(f"({rules.word})"))
    low, tokens = F.lower(clause), words(clause)

    def generic(w: Column) -> Column:
        out = F.lit(False)
        for stem in rules.generic:
            out = out | F.startswith(w, F.lit(stem))
        return out

    def points(w: Column) -> Column:
        n = F.when(F.length(w) >= 8, 8).otherwise(5)
        stem = F.substr(w, F.lit(1), n)
        near = (F.length(w) >= 5) & F.exists(tokens, lambda t: F.startswith(t, stem) | F.startswith(stem, F.substr(t, F.lit(1), n)))
        return F.when(generic(w), 0).when(F.contains(low, w) | near, F.when(F.length(w) >= 8, 2).otherwise(1)).otherwise(0)

    return F.aggregate(F.transform(words(topic), points), F.lit(0), lambda a, x: a + x)


def specificity(clause: Column, rules: ClauseRules) -> Column:
    return sum((F.when(F.contains(F.lower(clause), F.lit(s)), n).otherwise(0) for s, n in rules.specific), F.lit(0))


def condition_signal(clause: Column, rules: ClauseRules) -> Column:
    """Points for brackets, a place and length."""
    return F.when(F.contains(clause, F.lit("(")), 2).otherwise(0) + F.when(_is(clause, rules.place), 2).otherwise(0) + F.when(F.length(clause) >= 90, 1).otherwise(0)


def clause_features(units: DataFrame, rules: ClauseRules | None = None) -> DataFrame:
    """Adds ``action_class``, ``hits``, ``overlap`` (with the theory text, where the topic has no hits), ``specificity`` and ``condition`` to clauses.

    ``units``: clause, topic, theory_text (null: none), theory_only.
    """
    rules = rules or ClauseRules()
    hits = topic_hits(F.col("clause"), F.col("topic"), rules)
    out = units.withColumns({"action_class": action_class(F.col("clause"), F.col("theory_only"), rules.classes), "hits": hits, "specificity": specificity(F.col("clause"), rules), "condition": condition_signal(F.col("clause"), rules)})
    return out.withColumn("overlap", F.when(F.col("hits") > 0, 0).otherwise(topic_hits(F.col("clause"), F.col("theory_text"), rules)))


def select_clauses(units: DataFrame, keys: list[str], pos: str, rules: ClauseRules | None = None, finite: Column | None = None) -> DataFrame:
    """The clause table with features, ``rank`` by the six keys and ``chosen``, one clause a lesson.

    ``units`` has the columns of :func:`clause_features` and ``occurrence``. Where the lesson is theory, questions stand back while it has other clauses. Rank is null for
    clauses out of the choice: those below the best class; if no clause of the best class has hits, clauses from class 2 on with hits that are proven ``finite`` (a condition; all by default) take
    their place. Among all clauses of the best one's class the lesson's occurrence takes turns, the best one first.
    """
    rows = clause_features(units, rules)
    name = {c: free_name(units, c) for c in ("in_pool", "best_class", "top", "aligned", "away", "open", "first_class", "same", "turn", "of")}
    c = {k: F.col(v) for k, v in name.items()}
    lesson = Window.partitionBy(*keys)
    question = F.endswith(F.trim("clause"), F.lit("?"))
    rows = rows.withColumn(name["in_pool"], ~F.col("theory_only") | ~question | ~F.max(~question).over(lesson))
    rows = rows.withColumn(name["best_class"], F.max(F.when(c["in_pool"], F.col("action_class"))).over(lesson))
    top = c["in_pool"] & (F.col("action_class") == c["best_class"])
    aligned = c["in_pool"] & (F.col("action_class") >= 2) & (F.col("hits") > 0) & (finite if finite is not None else F.lit(True))
    rows = rows.withColumns({name["top"]: top, name["aligned"]: aligned})
    rows = rows.withColumn(name["away"], (F.max(F.when(c["top"], F.col("hits"))).over(lesson) == 0) & F.max(c["aligned"]).over(lesson))
    rows = rows.withColumn(name["open"], F.when(c["away"], c["aligned"]).otherwise(c["top"]))
    six = Window.partitionBy(*keys, name["open"]).orderBy(*[F.col(x).desc() for x in ("action_class", "hits", "overlap", "specificity", "condition")], pos)
    rows = rows.withColumn("rank", F.when(c["open"], F.row_number().over(six)))
    rows = rows.withColumn(name["first_class"], F.max(F.when(F.col("rank") == 1, F.col("action_class"))).over(lesson))
    rows = rows.withColumn(name["same"], F.col("action_class") == c["first_class"])
    alike = Window.partitionBy(*keys, name["same"])
    turn = F.row_number().over(alike.orderBy(F.coalesce("rank", F.lit(2)) != 1, pos)) - 1
    rows = rows.withColumns({name["turn"]: turn, name["of"]: F.count("*").over(alike)})
    return rows.withColumn("chosen", c["same"] & (c["turn"] == F.pmod(F.coalesce("occurrence", F.lit(0)), c["of"]))).drop(*name.values())


@dataclass(frozen=True)
class NeighbourRules:
    """What a chosen clause takes from others. Patterns whatever the case.

    ``frame``: (pattern that the neighbour has and the chosen one lacks, pattern that the chosen one must lack or None), for one clause before to two after.
    ``wanted``: in order of precedence, (pattern of the chosen one, pattern that it must lack or None, pattern of the first other clause that it asks for, whether that is practice); of practice only
    the parts between commas that have the pattern are taken. ``obligatory``: (pattern of the chosen one, pattern of the neighbour), of which the first that fits the neighbour decides; ``never``:
    clauses that are not obligatory for any; ``focus``: (pattern of an obligatory neighbour, pattern of the parts that are taken of it).
    """

    frame: list[tuple[str, str | None]]
    wanted: list[tuple[str, str | None, str, bool]]
    obligatory: list[tuple[str, str]]
    never: str | None = None
    focus: tuple[str, str] | None = None


#: The rules of the planning texts.
NEIGHBOURS = NeighbourRules(
    frame=[(r"\bг\.\s*[а-яёa-z]", None), (r"на местности|на маршруте|в поле", "упражнен")],
    wanted=[("меню", None, "костр|приготов", True), ("план подготовки", None, "плана?-график", True), (r"план(?=.*составлен)|составлен(?=.*план)|подготовк(?=.*поход)|поход(?=.*подготовк)", "снаряжен", "плана?-график", True), ("преодолен|препятств", None, "самострахов|альпеншток", True), ("горизонт", None, "потер|местонахожд", True), ("лагер|бивак", None, "^выбор места", False)],
    obligatory=[("лагер|бивак|привал|ночлег", r"^(?:определение|выбор)\s+мест"), ("уклад|рюкзак|подгонк|снаряжен", "снаряжен.*(?:уход|ремонт)|(?:уход|ремонт).*снаряжен"), ("план|составлен", "снаряжен"), (".", "уход|ремонт|костр|привал|ночлег|одежд|обув")],
    never=r"^(?:виды\b|упражнен|тренировочн|построен|заняти|изучен|знакомств|диктант|викторин|игр|соревнова)|закупк|фасовк|упаковк|сдач",
    focus=(r"^работа\s+со?\s", "уход|ремонт"),
)


def enrich_chosen(units: DataFrame, keys: list[str], pos: str, clause: str, chosen: str, rules: NeighbourRules = NEIGHBOURS) -> DataFrame:
    """Per lesson its chosen clause with the neighbours that belong to it: keys, ``selected``, ``source`` (all in the order of the lesson) and ``added``, what was
    taken for practice (W14, J14, X6).

    A bounded frame, one clause before to two after, is looked at around the chosen clause alone; then come what the wanted rules ask for, once, and obligatory
    neighbours from anywhere in the lesson. A text is taken once however often it stands there. Lessons without a chosen clause give no row; if several are marked, the first is the chosen one. Windows
    carry the chosen clause to the others, so no clause is joined with another.
    """
    lesson = Window.partitionBy(*keys)
    frame = lesson.orderBy("_at").rowsBetween(-2, 1)  # the chosen one lies at most two before or one after
    rows = units.select(*keys, F.trim(clause).alias("_clause"), F.coalesce(F.col(chosen), F.lit(False)).alias("_marked"), F.row_number().over(lesson.orderBy(pos)).alias("_at"))
    rows = rows.withColumn("_first", F.min(F.when(F.col("_marked"), F.col("_at"))).over(lesson)).where("_first IS NOT NULL")
    rows = rows.withColumn("_chosen", F.col("_at") == F.col("_first"))
    rows = rows.withColumns({"_selected": F.max(F.when(F.col("_chosen"), F.col("_clause"))).over(lesson), "_near": F.max("_chosen").over(frame)})
    own, sel = F.col("_clause"), F.col("_selected")
    other = ~F.col("_chosen") & (own != sel) & (own != "") & (~_is(own, rules.never) if rules.never else F.lit(True))
    rows = rows.withColumn("_other", ~F.col("_chosen") & (own != sel) & (own != ""))
    in_frame = F.lit(False)
    for pattern, unless in rules.frame:
        in_frame = in_frame | (_is(own, pattern) & ~_is(sel, pattern) & (~_is(sel, unless) if unless else F.lit(True)))
    rows = rows.withColumn("_frame", F.col("_other") & F.col("_near") & in_frame)
    of_text = Window.partitionBy(*keys, "_clause")
    # what the first rule that fits the chosen clause asks for, and the parts that have it
    asked, practice = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for here, unless, there, for_practice in reversed(rules.wanted):
        holds = _is(sel, here) & (~_is(sel, unless) if unless else F.lit(True))
        asked, practice = F.when(holds, there).otherwise(asked), F.when(holds, for_practice).otherwise(practice)
    rows = rows.withColumns({"_asked": asked, "_practice": practice, "_used": F.max("_frame").over(of_text)})
    fits = F.col("_other") & ~F.col("_used") & F.col("_asked").isNotNull() & F.regexp_like(F.lower(own), F.concat(F.lit("(?uU)"), "_asked"))
    rows = rows.withColumn("_fits", fits).withColumn("_wanted", F.col("_fits") & (F.col("_at") == F.min(F.when(F.col("_fits"), F.col("_at"))).over(lesson)))
    needs = F.lit(False)
    for here, there in reversed(rules.obligatory):
        needs = F.when(_is(own, there), _is(sel, here)).otherwise(needs)
    rows = rows.withColumn("_needed", other & ~F.col("_used") & ~F.max("_wanted").over(of_text) & needs)
    taken = rows.withColumn("_kind", F.when(F.col("_chosen"), 0).when(F.col("_frame"), 1).when(F.col("_wanted"), F.when(F.col("_practice"), 2).otherwise(1)).when(F.col("_needed"), 3)).where("_kind IS NOT NULL")
    once = Window.partitionBy(*keys, "_clause").orderBy("_kind", "_at")
    taken = taken.withColumn("_copy", F.row_number().over(once)).where("_copy = 1")
    parts = F.filter(F.transform(F.split("_clause", r",\s+"), F.trim), lambda p: p != "")
    pattern = F.when(F.col("_kind") == 2, F.col("_asked"))
    if rules.focus:
        pattern = pattern.when((F.col("_kind") == 3) & _is(own, rules.focus[0]), rules.focus[1])
    focused = F.filter(parts, lambda p: F.regexp_like(F.lower(p), F.concat(F.lit("(?uU)"), pattern)))
    pieces = F.when(pattern.isNotNull() & (F.size(focused) > 0), focused).otherwise(F.array("_clause"))
    piece = taken.select(*keys, "_selected", "_kind", "_at", F.posexplode(pieces).alias("_i", "_piece"))
    all_pieces = F.array_sort(F.collect_list(F.struct("_at", "_i", "_piece")))
    practice = F.array_sort(F.collect_list(F.when(F.col("_kind") >= 2, F.struct("_kind", "_at", "_i", "_piece"))))
    out = piece.groupBy(*keys).agg(F.max("_selected").alias("selected"), all_pieces.alias("_all"), practice.alias("_more"))
    return out.select(*keys, "selected", F.array_join(F.transform("_all", lambda x: x["_piece"]), ". ").alias("source"), F.transform("_more", lambda x: x["_piece"]).alias("added"))


def attach_dependents(units: DataFrame, keys: list[str], pos: str, clause: str, dependent: Column) -> DataFrame:
    """Clauses that only go on with the one before, joined to it: keys, ``block`` from 1, ``first_pos``, ``clause`` and ``n_parts``.

    A block breaks before each clause that is not ``dependent``, and before a dependent one that has none before it. Last dots of the part before go, and the parts are joined by ': '.
    """
    names = {c: free_name(units, c) for c in ("opens", "block")}
    lesson = Window.partitionBy(*keys).orderBy(pos)
    opens = ~F.coalesce(dependent, F.lit(False)) | (F.row_number().over(lesson) == 1)
    rows = units.withColumn(names["opens"], opens).withColumn(names["block"], F.sum(F.col(names["opens"]).cast("int")).over(lesson.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(clause).alias("c"))))
    out = rows.groupBy(*keys, F.col(names["block"]).alias("block")).agg(parts.alias("parts"))
    bare = F.transform("parts", lambda x, i: F.when(i < F.size("parts") - 1, F.regexp_replace(x["c"], r"[ .]+$", "")).otherwise(x["c"]))
    return out.select(*keys, "block", F.get("parts", F.lit(0))["p"].alias("first_pos"), F.array_join(bare, ": ").alias("clause"), F.size("parts").alias("n_parts"))


def dependent_catalogue(clause: Column, rules: list[ClassRule] | None = None) -> Column:
    """Whether a clause has no activity of its own: a quoted name, or two parts or more between commas, and nothing that opens an action (class 2 or more)."""
    rules = rules or CLASS_RULES
    acts = lambda x: action_class(x, F.lit(False), rules) >= 2
    parts = F.filter(F.transform(F.split(clause, r",\s+"), F.trim), lambda p: p != "")
    return ~acts(clause) & (F.regexp_like(clause, F.lit(r'[«»"„“]')) | ((F.size(parts) >= 2) & ~F.exists(parts, acts)))


#: Nouns of actions and the finite verbs that they become.
VERB_OF_NOUN = {
    "анализ": "анализирует", "выбор": "выбирает", "выполнение": "выполняет", "знакомство": "знакомится", "изготовление": "изготавливает", "измерение": "измеряет", "изучение": "изучает", "конструирование": "конструирует",
    "наблюдение": "наблюдает", "оказание": "оказывает", "определение": "определяет", "организация": "организует", "ориентирование": "ориентирует", "отработка": "отрабатывает", "подбор": "подбирает", "подготовка": "подготавливает",
    "подгонка": "подгоняет", "посещение": "посещает", "постановка": "ставит", "построение": "строит", "приготовление": "готовит", "применение": "применяет", "проверка": "проверяет", "проведение": "проводит",
    "развертывание": "развертывает", "разжигание": "разжигает", "разработка": "разрабатывает", "разучивание": "разучивает", "расчет": "рассчитывает", "расчёт": "рассчитывает", "решение": "решает", "рисование": "рисует",
    "свертывание": "свертывает", "смешивание": "смешивает", "составление": "составляет", "укладка": "укладывает", "упаковка": "упаковывает", "уход": "ухаживает", "участие": "участвует", "отыскание": "находит",
    "фасовка": "фасует", "чтение": "читает", "закупка": "закупает", "ремонт": "ремонтирует", "ведение": "ведёт", "выступление": "выступает", "формирование": "формирует", "оценка": "оценивает", "отбор": "отбирает",
    "заслушивание": "заслушивает",
}


def looked_up(x: Column, table: dict[str, str]) -> Column:
    """The entry of a small fixed table for a word, whatever the case; null without one (J15). The table is part of the plan, so nothing is joined."""
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[F.lower(x)]
