"""Text of stored files: a format by extension, read in tasks over ``binaryFile``."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.text import extension, last_segment

#: The formats that may be uploaded.
FORMATS = ("pdf", "docx", "xlsx", "xls")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: (text, metadata) of a file's bytes
Extractor = Callable[[bytes], tuple[str, dict]]


def docx_text(data: bytes) -> tuple[str, dict]:
    """Paragraphs of the document body, each with a blank line behind it."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for p in body.iter(f"{_W}p"):
        parts = [n.text or "" if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" if n.tag == f"{_W}br" else "" for n in p.iter()]
        lines.append("".join(parts))
    return "".join(f"{x}\n\n" for x in lines), {"original_format": "docx"}


def sheet_text(name: str, rows: list[list[str]]) -> str:
    """A sheet's heading and one line for each row that is not empty, by its place."""
    return f"[Sheet: {name}]\n" + "".join(f"Row {n}: {', '.join(r)}\n" for n, r in enumerate(rows, 1) if r)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_text(data: bytes) -> tuple[str, dict]:
    """Every sheet in workbook order, joined by a blank line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = []
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = links[s.get(f"{_R}id")].lstrip("/")
            rows: list[list[str]] = []
            for r in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
                at = int(r.get("r", len(rows) + 1))
                rows += [[] for _ in range(at - 1 - len(rows))]
                cells: list[str] = []
                for c in r.iter(f"{_S}c"):
                    value = c.findtext(f"{_S}v") or "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    value = shared[int(value)] if c.get("t") == "s" and value else value
                    if value:
                        k = _column(c.get("r", "")) if c.get("r") else len(cells)
                        cells += [""] * (k + 1 - len(cells))
                        cells[k] = value
                rows.append(cells)
            sheets.append(sheet_text(s.get("name"), rows))
    return "\n\n".join(sheets), {"sheet_count": len(sheets), "original_format": "excel"}


def unsupported(kind: str) -> Extractor:
    def fail(data: bytes):
        raise ValueError(f"Unsupported file type: {kind}")

    return fail


#: pdf and xls have no reader here; pass one to ``extract_text``.
EXTRACTORS: dict[str, Extractor] = {"docx": docx_text, "xlsx": xlsx_text, "pdf": unsupported("pdf"), "xls": unsupported("xls")}


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime, content, file_type of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("file_type", extension(F.col("path")))


def allowed(name: Column) -> Column:
    """Whether a file of that name may be uploaded, by its extension; null may not."""
    return F.coalesce(extension(name).isin(*FORMATS), F.lit(False))


def fetch(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files of the wanted paths; a path without a file has null content and an error."""
    held = wanted.select("path").distinct().join(stored, "path", "left")
    return held.withColumn("error", F.when(F.col("content").isNull(), F.concat(F.lit("Object not found: "), F.col("path"))))


def extract_text(stored: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """path, filename, file_type, file_size, text, metadata columns, error of each file.

    A file that can't be read gives a row with its error and no text, so that one bad
    file stops no other. Blank texts are errors too.
    """
    known = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, name, kind, length, content in zip(batch["path"], batch["filename"], batch["file_type"], batch["file_size"], batch["content"]):
                text, meta, error = None, {}, None
                try:
                    text, meta = known.get(kind, unsupported(kind))(bytes(content))
                    if not text.strip():
                        text, error = None, "No text content could be extracted from the document"
                except Exception as e:  # told in the row
                    error = str(e) or type(e).__name__
                rows.append((path, name, kind, length, text, meta.get("original_format"), meta.get("page_count"), meta.get("sheet_count"), error))
            yield pd.DataFrame(rows, columns=names).astype({"page_count": "Int32", "sheet_count": "Int32"})

    schema = "path string, filename string, file_type string, file_size long, text string, original_format string, page_count int, sheet_count int, error string"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return stored.select("path", last_segment(F.col("path")).alias("filename"), "file_type", F.col("length").alias("file_size"), "content").mapInPandas(run, schema)
