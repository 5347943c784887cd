"""Word documents as tables: paragraphs and table cells, read by executors from a binary source.

A DOCX file is a ZIP archive of XML. Each task unpacks its own files; no document passes through the driver. What can't be read gives
a row with a status instead of failing the job.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_UPLOAD = 10 * 1024 * 1024
#: The first bytes of ZIP containers and of legacy compound files.
ZIP_MAGIC, OLE_MAGIC = "504B0304", "D0CF11E0A1B11AE1"
PARAGRAPHS = "doc_id string, pos int, text string, is_bold boolean, alignment string"
CELLS = "doc_id string, table_pos int, row int, col int, n_cols int, paragraphs array<string>"


def read_files(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    """Files as ``doc_id`` (path), ``name``, ``size`` and ``content``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def check_uploads(files: DataFrame, allowed: tuple[str, ...] = ("docx",)) -> DataFrame:
    """Each file without its content and with ``status``: ok, bad_extension, empty, too_large or bad_signature."""
    suffix = F.lower(F.element_at(F.split("name", r"\."), -1))
    head = F.hex(F.substring("content", 1, 8))
    signed = F.when(suffix == "doc", F.startswith(head, F.lit(OLE_MAGIC))).otherwise(F.startswith(head, F.lit(ZIP_MAGIC)))
    status = F.when(~suffix.isin(*allowed), "bad_extension").when(F.col("size") == 0, "empty").when(F.col("size") > MAX_UPLOAD, "too_large").when(~signed, "bad_signature").otherwise("ok")
    return files.withColumn("status", status).drop("content")


def _text(p: ElementTree.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == _W + "t":
            out.append(e.text or "")
        elif e.tag == _W + "tab":
            out.append("\t")
        elif e.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _on(e: ElementTree.Element | None) -> bool:
    return e is not None and e.get(_W + "val", "true") not in ("0", "false", "off")


def _paragraph(p: ElementTree.Element) -> tuple[str, bool, str | None]:
    """Text, whether every run with text is marked bold, and the alignment."""
    runs = [r for r in p.iter(_W + "r") if _text(r).strip()]
    bold = bool(runs) and all(_on(r.find(f"{_W}rPr/{_W}b")) for r in runs)
    jc = p.find(f"{_W}pPr/{_W}jc")
    return _text(p), bold, None if jc is None else jc.get(_W + "val")


def _grid(table: ElementTree.Element) -> list[list[list[str]]]:
    """Rows of cells of paragraphs; a cell merged over columns or rows is repeated in each place."""
    rows: list[list[list[str]]] = []
    for tr in table.findall(_W + "tr"):
        row: list[list[str]] = []
        for tc in tr.findall(_W + "tc"):
            span = tc.find(f"{_W}tcPr/{_W}gridSpan")
            merge = tc.find(f"{_W}tcPr/{_W}vMerge")
            content = [_text(p) for p in tc.findall(_W + "p")]
            if merge is not None and merge.get(_W + "val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                content = rows[-1][len(row)]
            row += [content] * (int(span.get(_W + "val", "1")) if span is not None else 1)
        rows.append(row)
    return rows


def _body(content: bytes) -> ElementTree.Element | None:
    """The document's body; None for what is no readable document."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return ElementTree.fromstring(z.read("word/document.xml")).find(_W + "body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, ValueError):
        return None


def paragraphs(files: DataFrame) -> DataFrame:
    """The paragraphs of each document outside its tables, in order; an unreadable document has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, i, *_paragraph(p)) for doc, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True) if raw and (body := _body(raw)) is not None for i, p in enumerate(body.findall(_W + "p"))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string())], ["doc_id", "pos", "text", "is_bold", "alignment"])

    return files.select("doc_id", "content").mapInArrow(run, PARAGRAPHS)


def cells(files: DataFrame) -> DataFrame:
    """The cells of each document's tables; ``n_cols`` is the width of the cell's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = _body(raw) if raw else None
                for t, table in enumerate(body.findall(_W + "tbl") if body is not None else ()):
                    rows += [(doc, t, r, c, len(row), cell) for r, row in enumerate(_grid(table)) for c, cell in enumerate(row)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:5]], pa.array(cols[5], pa.list_(pa.string()))], ["doc_id", "table_pos", "row", "col", "n_cols", "paragraphs"])

    return files.select("doc_id", "content").mapInArrow(run, CELLS)
