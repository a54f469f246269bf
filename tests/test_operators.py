"""Hand-written cases of functions and operators."""

import io
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketlake.functions import text as T
from docketlake.operators import changes as C
from docketlake.operators import relational as R
from docketlake.operators import retrieval as M
from docketlake.operators import security as S
from docketlake.sources.embed import HashingEmbedder, embed, embed_query
from docketlake.sources.extract import docx_text, extract_text, files, sheet_text, xlsx_text
from docketlake.sources.store import SnapshotStore
from docketlake.streaming.ingest import ingest, ingest_stream


def col(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def model_chunks(text, size, overlap):
    import re

    w = re.split("[\t\n\x0b\x0c\r \xa0  -     　﻿]+", text)
    out = [" ".join(w[s : s + size]) for s in range(0, len(w), size - overlap)]
    return [c for c in out if c.strip(" ")] or [text]


def test_chunks_by_hand(spark):
    assert col(spark, lambda x: T.chunks(x, 2, 1), "  a b c\n") == [" a", "a b", "b c", "c "]
    assert col(spark, lambda x: T.chunks(x, 2, 1), "   ") == ["   "]
    assert col(spark, lambda x: T.chunks(x, 2, 1), "") == [""]
    got = col(spark, T.chunks, " ".join(map(str, range(1000))))
    assert [len(c.split()) for c in got] == [1000, 200] and got[1].startswith("800 ")
    for size, overlap in ((2, 2), (0, 0), (3, -1)):
        with pytest.raises(ValueError):
            T.chunks(F.col("x"), size, overlap)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n﻿\x85 ", max_size=30), min_size=1, max_size=8), st.integers(1, 5), st.integers(0, 4))
def test_chunks_like_a_model(spark, texts, size, overlap):
    if overlap >= size:
        return
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.chunks(F.col("x"), size, overlap).alias("c")).collect()
    assert {r["i"]: r["c"] for r in rows} == {i: model_chunks(x, size, overlap) for i, x in enumerate(texts)}


def test_white_space_set(spark):
    assert col(spark, T.trim, "﻿ a  ") == "a"
    assert col(spark, T.trim, "\x85a​") == "\x85a​"
    assert col(spark, T.is_blank, None) and col(spark, T.is_blank, " \n　")


def test_redlines(spark):
    kind = "array<struct<status: string, original_text: string, suggested_text: string>>"
    fold = lambda text, items: spark.createDataFrame([(text, items)], f"t string, s {kind}").select(T.apply_redlines(F.col("t"), F.col("s"))).first()[0]
    assert fold("xa.ba.b", [("accepted", "a.b", "$1")]) == "x$1a.b"
    assert fold("abc", [("rejected", "a", "x"), ("accepted", "b", ""), ("accepted", None, "y")]) == "abc"
    assert fold("aa", [("accepted", "a", "b"), ("accepted", "b", "c")]) == "ca"
    assert fold("abc", [("accepted", "zz", "y")]) == "abc"


def test_replies(spark):
    parse = lambda x: tuple(col(spark, T.parse_reply, x))
    assert parse('ok {"ready": true, "message": "m"} end') == (True, "m")
    assert parse("not json") == (False, "not json")
    assert parse('{"ready": "true", "x": 1}')[1] == '{"ready": "true", "x": 1}'
    assert parse("{broken") == (False, "{broken")
    items = lambda x: [tuple(r) for r in col(spark, T.parse_suggestions, x)]
    assert items('a [{"clause_reference": "1", "original_text": "o"}] b') == [("1", "o", None, None)]
    assert items("[]") == items("junk") == items('{"original_text": "o"}') == []
    assert items("[1]") == [(None, None, None, None)]


def test_small_functions(spark):
    assert col(spark, T.next_stage_status, "not_started") == "in_progress"
    assert col(spark, T.next_stage_status, "complete") == "not_started"
    assert col(spark, T.paragraphs, "a\n\n \nb") == ["a", "b"]
    assert col(spark, T.extension, "A.b.DOCX") == "docx"
    assert col(spark, T.last_segment, "a/b/c.x") == "c.x"
    assert col(spark, T.none_if_empty, "") is None
    assert col(spark, T.dashed, "a  b\nc") == "a-b-c"
    blocks = [("thinking", "t"), ("text", "x")]
    assert col(spark, lambda b: T.first_text_block(b, "{}"), blocks, "array<struct<type: string, text: string>>") == "x"
    assert col(spark, lambda b: T.first_text_block(b, "{}"), [], "array<struct<type: string, text: string>>") == "{}"


VECTORS = "id long, content string, embedding array<float>, matter_id long, document_type_id long, is_precedent boolean"


def test_match_documents(spark):
    rows = [(1, "a", [1.0, 0.0], 7, 1, False), (2, "b", [1.0, 1.0], None, 1, True), (3, "c", [0.0, 0.0], 7, 1, False), (4, "d", None, 7, 1, False), (5, "e", [1.0], 7, 1, False), (6, "f", [2.0, 0.0], 7, 2, False)]
    chunks = spark.createDataFrame(rows, VECTORS)
    ids = lambda *a, **k: [r["id"] for r in M.match_documents(chunks, [1.0, 0.0], *a, **k).collect()]
    assert ids() == [1, 6, 2]
    assert ids(1.0 - 1e-12) == [1, 6] and ids(1.0) == []  # equal to the threshold: dropped
    assert ids(match_count=1) == [1]
    assert ids(filter_matter_id=7) == [1, 6] and ids(filter_document_type_id=1, precedent_only=True) == [2]
    assert [r["id"] for r in M.scope(chunks, matter_id=7, matter_or_precedent=True).collect()] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        M.match_documents(chunks, [1.0, 0.0], match_count=0)
    batch = M.match_documents_batch(chunks, chunks.filter("id IN (1, 2)").select(F.col("id").alias("query_id"), "embedding"), 0.5, 2, slices=3)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in batch.collect()) == [(1, 1, 1), (1, 2, 6), (2, 1, 2), (2, 2, 1)]


def test_rendering(spark):
    none = spark.createDataFrame([], "id long, content string, similarity double")
    assert M.render_sources(none).first()["context"] == M.NO_SOURCES
    two = spark.createDataFrame([(2, "b", 0.5), (1, "a", 0.754)], "id long, content string, similarity double")
    assert M.render_sources(two).first()["context"] == "[Source 1] (Similarity: 75.4%)\na\n\n---\n\n[Source 2] (Similarity: 50.0%)\nb"


def test_nested_lookup_and_cardinality(spark):
    docs = spark.createDataFrame([(1, 5), (2, None)], "id long, type_id long")
    types = spark.createDataFrame([(5, "T")], "id long, name string")
    versions = spark.createDataFrame([(1, 2), (1, 1)], "doc_id long, n int")
    out = {r["id"]: r for r in R.nested(R.lookup(docs, types, "type_id", "type", ["name"]), versions, "doc_id", "versions", ["n"], ["n"]).collect()}
    assert out[1]["type"]["name"] == "T" and out[2]["type"] is None
    assert [v["n"] for v in out[1]["versions"]] == [1, 2] and out[2]["versions"] == []
    assert R.one(docs.filter("id = 1"))["type_id"] == 5 and R.one_or_none(docs.filter("id = 9")) is None
    for bad in (docs, docs.filter("id = 9")):
        with pytest.raises(LookupError):
            R.one(bad)


def test_rules(spark):
    profiles = spark.createDataFrame([("u",), ("v",)], "id string")
    roles = spark.createDataFrame([("u", "admin"), ("v", "associate")], "user_id string, role string")
    rows = spark.createDataFrame([("u", 1), ("v", 2), (None, 3)], "user_id string, n int")
    see = lambda table, user, action="select": sorted(r["n"] for r in S.secure(rows, table, user, profiles, roles, action).collect())
    assert see("matters", "v") == [1, 2, 3] and see("matters", "x") == [] and see("matters", "v", "delete") == []
    assert see("matters", "u", "delete") == [1, 2, 3] and see("document_versions", "u", "update") == []
    assert see("support_requests", "v") == [2] and see("support_requests", "u") == [1, 2, 3] and see("support_requests", None) == []
    assert set(S.RULES) - {"objects"} == set(__import__("docketlake.schema", fromlist=["TABLES"]).TABLES)


def test_changes(spark):
    rows = spark.createDataFrame([(1, 1, "pending"), (2, 1, "accepted"), (3, 1, "rejected"), (4, 2, "pending")], "id long, document_version_id long, status string")
    new = spark.createDataFrame([(9, 1, "pending")], rows.schema)
    once = C.replace_pending(rows, 1, new)
    assert sorted(r["id"] for r in once.collect()) == [2, 3, 4, 9]
    assert sorted(r["id"] for r in C.replace_pending(once, 1, new).collect()) == [2, 3, 4, 9]
    stamped = rows.withColumn("updated_at", F.lit(None).cast("timestamp"))
    got = {r["id"]: r for r in C.update(stamped, F.col("id") == 1, {"status": F.lit("accepted")}, F.timestamp_seconds(F.lit(0))).collect()}
    assert got[1]["status"] == "accepted" and got[1]["updated_at"] is not None and got[4]["updated_at"] is None
    tables = {"clients": spark.createDataFrame([(1,)], "id long"), "matters": spark.createDataFrame([(5, 1), (6, None)], "id long, client_id long"), "matter_documents": spark.createDataFrame([(7, 5)], "id long, matter_id long"), "document_versions": spark.createDataFrame([(8, 7)], "id long, matter_document_id long")}
    after = C.after_deletion(tables, "clients", F.col("id") == 1)
    assert [r["client_id"] for r in after["matters"].collect()] == [None, None] and after["document_versions"].count() == 1
    after = C.after_deletion(tables, "matters", F.col("id") == 5)
    assert after["matter_documents"].count() == after["document_versions"].count() == 0


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.read("user_roles").count() == 0
    now = F.timestamp_seconds(F.lit(0))
    row = lambda i, u, r: spark.range(1).select(F.lit(i).alias("id"), F.lit(u).alias("user_id"), F.lit(r).alias("role"), now.alias("created_at"))
    store.write("user_roles", row("1", "u", "admin"))
    store.write("user_roles", C.insert(store.read("user_roles"), row("2", "u", "partner")))
    assert store.version("user_roles") == 2 and store.read("user_roles").count() == 2
    for bad in (row("1", "v", "admin"), row("3", "u", "admin"), row("3", "v", "king")):
        with pytest.raises(ValueError):
            store.write("user_roles", C.insert(store.read("user_roles"), bad))
    assert store.read("user_roles").count() == 2


def docx(*lines):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t>{x}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx():
    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="A" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>h</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row r="3"><c r="A3"><v>5</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_extraction_and_ingest(spark, tmp_path):
    assert docx_text(docx("a", "b"))[0] == "a\n\nb\n\n"
    assert sheet_text("S", [["x"], [], ["y", "z"]]) == "[Sheet: S]\nRow 1: x\nRow 3: y, z\n"
    assert xlsx_text(xlsx())[0] == "[Sheet: A]\nRow 1: h, , 2\nRow 3: 5\n"
    (tmp_path / "in").mkdir()
    for name, data in (("a.docx", docx("one two", "three")), ("b.xlsx", xlsx()), ("c.pdf", b"%PDF"), ("d.docx", b"junk"), ("e.docx", docx(" "))):
        (tmp_path / "in" / name).write_bytes(data)
    found = {r["filename"]: r for r in extract_text(files(spark, f"file://{tmp_path}/in")).collect()}
    assert found["a.docx"]["error"] is None and found["b.xlsx"]["sheet_count"] == 1
    assert "Unsupported" in found["c.pdf"]["error"] and found["d.docx"]["error"] and "No text" in found["e.docx"]["error"]
    rows, report = ingest(files(spark, f"file://{tmp_path}/in"), HashingEmbedder(8), "precedent-library", "2024-01-01", is_precedent=True, size=2, overlap=1)
    assert sorted(r["content"] for r in rows.select("content").collect())[:1] and report.filter("ingested").count() == 2
    assert all(len(r["embedding"]) == 8 for r in rows.collect())
    q = ingest_stream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp", HashingEmbedder(8), "matter-documents", upload_date="2024-01-01")
    q.awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out/report").count() == 5


def test_embedding(spark):
    e = HashingEmbedder(16)
    rows = embed(spark.createDataFrame([("a b",), ("",), (None,)], "content string"), e, batch=2).collect()
    assert [round(sum(x * x for x in r["embedding"]), 3) for r in rows] == [1.0, 0.0, 0.0]
    assert embed_query("a b", e) == pytest.approx(rows[0]["embedding"])
    with pytest.raises(ValueError):
        embed_query("  ", e)


def test_word_files_and_replies(spark):
    from docketlake.sources.produce import with_docx, with_reply

    rows = spark.createDataFrame([("a & b\n\nc", "s"), (None, "t")], "text string, s string")
    out = with_docx(rows).collect()
    assert docx_text(bytes(out[0]["docx"]))[0] == "a & b\n\nc\n\n" and docx_text(bytes(out[1]["docx"]))[0] == ""

    def model(systems, questions):
        return [[("thinking", "hm"), ("text", f"{s}:{q}")] if q else [] for s, q in zip(systems, questions)]

    got = with_reply(rows, model, "s", "text", default="{}").collect()
    assert [r["reply"] for r in got] == ["s:a & b\n\nc", "{}"]
