"""Checks of files before they are read, and the choice between sources."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes, first bytes by extension, phrases of normative documents and of calendar forms.
MOST_BYTES = 10 << 20
FIRST_BYTES = {".docx": "504B0304", ".doc": "D0CF11E0A1B11AE1"}
NORMATIVE = ["федеральный закон", "постановление правительства", "приказ министерства", "зарегистрировано в министерстве юстиции", "нормативный правовой акт"]
CALENDAR_FORM = ["календарный план", "теоретические занятия", "практические занятия", "тип занятия", "планируемый результат", "вид контроля"]


def upload_fault(name: Column, content: Column, allowed: dict[str, str] | None = None, most: int = MOST_BYTES) -> Column:
    """The first rule that a file breaks: extension, empty, size or content (its first bytes); null if none. A null content is empty."""
    first = allowed or FIRST_BYTES
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    size = F.coalesce(F.octet_length(content), F.lit(0))
    right = F.lit(False)
    for ext, start in first.items():
        right = F.when(suffix == ext, F.startswith(F.hex(F.substring(content, 1, len(start) // 2)), F.lit(start))).otherwise(right)
    return F.when(~suffix.isin(*first), "extension").when(size == 0, "empty").when(size > most, "size").when(~right, "content")


#: Members that a document archive must have.
MEMBERS = ["[Content_Types].xml", "word/document.xml"]
_CHUNK = 1 << 16


def _archive_fault(content: bytes | None, members: list[str], most: int) -> str | None:
    try:
        with zipfile.ZipFile(BytesIO(content or b"")) as archive:
            found = archive.infolist()
            if not set(members) <= {m.filename for m in found}:
                return "members"
            if sum(m.file_size for m in found) > most:
                return "unpacked_size"
            for m in found:
                with archive.open(m) as stream:  # the library compares the member's CRC at its end
                    while stream.read(_CHUNK):
                        pass
    except (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, RuntimeError, OSError, EOFError, NotImplementedError):
        return "damaged"
    return None


def archive_faults(files: DataFrame, content: str = "content", members: list[str] | None = None, most: int = 20 * MOST_BYTES, name: str = "archive_fault") -> DataFrame:
    """Adds the first fault of each file as a ZIP archive (S13): 'damaged' (no directory, or a member that can't be unpacked or whose checksum differs), 'members' (one that must be there is missing),
    'unpacked_size' (the directory declares more than ``most`` bytes in all); null if it is sound.

    Members are read in chunks in the task that has the file, and never past the size that the directory declares, so a small file that unpacks to a huge one costs no memory.
    """
    needed = members or MEMBERS
    schema = T.StructType([*files.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(content)
            faults = [_archive_fault(column[i].as_py(), needed, most) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(faults, pa.string())], schema.fieldNames())

    return files.mapInArrow(run, schema)


#: The shape of an organisation's template: columns, rows of the head, most rows, and words of its head.
TEMPLATE_COLUMNS, HEAD_ROWS, MOST_ROWS = 8, 2, 3


def template_faults(documents: DataFrame, cells: DataFrame, markers: list[str], columns: int = TEMPLATE_COLUMNS, head: int = HEAD_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """The first rule of a template's shape that each document breaks (S18): doc_id, ``fault``: tables (not exactly one), columns, rows, markers (a word missing in the head), body (a cell below the head has
    text); null if it has the shape.

    ``cells``: doc_id, table, row and col from 0, text. ``documents``: doc_id; those without cells have no table. One grouping reads all rules.
    """
    text = F.coalesce("text", F.lit(""))
    in_head = F.col("row") < head
    has = [F.bool_or(in_head & F.contains(F.lower(text), F.lit(m))).alias(f"m{i}") for i, m in enumerate(markers)]
    by = cells.groupBy("doc_id").agg(F.countDistinct("table").alias("tables"), (F.max("col") + 1).alias("columns"), (F.max("row") + 1).alias("rows"), F.bool_or(~in_head & (F.trim(text) != "")).alias("body"), *has)
    every = F.lit(True)
    for i in range(len(markers)):
        every = every & F.col(f"m{i}")
    fault = F.when(F.coalesce("tables", F.lit(0)) != 1, "tables").when(F.col("columns") != columns, "columns").when(~F.col("rows").between(head, most_rows), "rows").when(~every, "markers").when(F.col("body"), "body")
    return documents.select("doc_id").join(by, "doc_id", "left").select("doc_id", fault.alias("fault"))


def purpose_fault(purpose: Column, text: Column, n_topics: Column, n_sections: Column, n_items: Column, has_facts: Column) -> Column:
    """Why a file doesn't serve its purpose (S15): 'normative' or 'calendar' where it is such a document instead, 'content' where it lacks what the purpose needs; null if it serves.

    A plan needs topics and sections, a programme content items and a title, goal or tasks, a template the calendar form's phrases. Null counts are none.
    """
    some = lambda n: F.coalesce(n, F.lit(0)) > 0
    form = F.coalesce(looks_like_calendar_form(text), F.lit(False))
    serves = F.when(purpose == "plan", some(n_topics) & some(n_sections)).when(purpose == "programme", some(n_items) & F.coalesce(has_facts, F.lit(False))).otherwise(form)
    return F.when(F.coalesce(looks_normative(text), F.lit(False)), "normative").when(form & (purpose != "template"), "calendar").when(~serves, "content")


def programme_reader(name: Column) -> Column:
    """Which reader a programme's file needs by the end of its name, whatever the case (S11): 'docx', 'doc', or null for any other."""
    low = F.lower(name)
    return F.when(F.endswith(low, F.lit(".docx")), "docx").when(F.endswith(low, F.lit(".doc")), "doc")


def looks_normative(text: Column) -> Column:
    """Whether a text has a phrase of normative documents, whatever the case."""
    low = F.lower(text)
    return F.greatest(*[F.contains(low, F.lit(p)) for p in NORMATIVE])


def looks_like_calendar_form(text: Column) -> Column:
    """Whether at least three of the calendar form's phrases stand in a text."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(p)).cast("int") for p in CALENDAR_FORM), F.lit(0)) >= 3


def preferred_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Per key the row of the first source that has it; ``source`` is that source's number from 1."""
    rows = [df.withColumn("source", F.lit(i)) for i, df in enumerate(sources, 1)]
    every = rows[0]
    for df in rows[1:]:
        every = every.unionByName(df)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("source"))
    return every.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def by_preference(df: DataFrame, keys: list[str], order_by: list[str], levels: list[Column]) -> DataFrame:
    """Per key the first row of the best level that any row reaches, and the ``level`` from 1; keys without such a row give none."""
    level = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(levels, 1)])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("level", *order_by))
    return df.withColumn("level", level).where("level IS NOT NULL").withColumn("_rank", rank).where("_rank = 1").drop("_rank")
