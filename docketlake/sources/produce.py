"""What leaves the tables: Word files of texts, and replies of a pluggable model."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import first_text_block, paragraphs

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"

#: system texts and questions to one list of (type, text) blocks each
Model = Callable[[list[str], list[str]], list]


def docx_bytes(lines: list[str]) -> bytes:
    """A Word file with one paragraph a line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{main}"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def with_docx(rows: DataFrame, text_col: str = "text", as_: str = "docx") -> DataFrame:
    """``rows`` with a Word file of each text: a paragraph for each line that is not blank."""

    @F.pandas_udf("binary")
    def files(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([docx_bytes(list(x) if x is not None else []) for x in part])

    return rows.withColumn(as_, files(paragraphs(F.col(text_col))))


def with_reply(rows: DataFrame, model: Model, system_col: str, question_col: str, as_: str = "reply", default: str | None = None, batch: int = 16) -> DataFrame:
    """``rows`` with a model's reply: the text of its first text block, else a default."""

    @F.pandas_udf("array<struct<type: string, text: string>>")
    def blocks(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for systems, questions in parts:
            s, q = systems.fillna("").tolist(), questions.fillna("").tolist()
            got = [x for k in range(0, len(s), batch) for x in model(s[k : k + batch], q[k : k + batch])]
            yield pd.Series([[{"type": t, "text": x} for t, x in g] for g in got], dtype=object)

    return rows.withColumn(as_, first_text_block(blocks(F.col(system_col), F.col(question_col)), default))
