"""The pipeline on empty and awkward tables, and the queries of operators that SQL can't express."""

import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from docketlake.llm import language_id, pii, token_counts
from docketlake.llm.queries import WORD_BPE, queries

from ..conftest import SF
from .test_llm import awkward, check_packing, crc, plain_spans

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, docs, labels):
    docs.selectExpr("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


def test_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, spark.createDataFrame([], DOCUMENTS), []))
    assert out.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_awkward_rows_without_labels(spark, tmp_path):
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, awkward(spark), [])).collect()
    # one of the empty texts (the larger id), white space, "one two" (5), one of the long near copies, both others
    assert {r["doc_id"] for r in out} == {2, 3, 5, 7, 9, 10}
    assert sum(r["doc_id"] == 9 for r in out) == 1 and [r["doc_tokens"] for r in out if r["doc_id"] in (2, 3)] == [1, 1]
    check_packing(out, 2048)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_bpe_query(spark, texts):
    library = Tokenizer.from_file(WORD_BPE)
    got = {r["doc_id"]: r for r in queries()["op4_bpe"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        data = b"".join(k.to_bytes(4, "little") for k in ids)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"]) == (len(ids), hashlib.sha256(data).hexdigest())
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pii_query(spark, texts):
    got = {r["doc_id"]: r for r in queries()["op5_pii"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        want = plain_spans(t)
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        told = [f"{k}:{a}:{b}" for k, a, b in want]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(got[d]["spans"].split(",")) | {""}


def test_quality_and_language_queries(spark, texts):
    for name, n, k in (("op7_quality", 3, 1), ("op8_language", 4, 2)):
        got = {r["doc_id"]: r for r in queries()[name](spark, SF).collect()}
        assert set(got) == set(texts) and all(r["held_out"] == (crc(d, n) == k) and 0 <= r["score"] <= 1 for d, r in got.items())
        if n == 3:
            assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())
        else:
            assert all((r["lang_pred"] == "und") == (not language_id.words_of(texts[d])) for d, r in got.items())


def test_null_ids_are_held_out_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(None, "some words here", "en", "s", 15), (1, "other words there", "en", "s", 17)], DOCUMENTS)
    at = folder(spark, tmp_path, rows, [(1, 1, 0), (None, 0, 0)])
    for name in ("op7_quality", "op8_language", "op10_lm_scoring"):
        assert [r["held_out"] for r in queries()[name](spark, at).filter("doc_id IS NULL").collect()] == [False]


def test_token_count_query(spark, texts):
    counter = token_counts.TokenCounter(WORD_BPE)
    got = {r["doc_id"]: r for r in queries()["op9_token_counts"](spark, SF).collect()}
    assert set(got) == set(texts)
    vocabulary, longest = set(), 0
    for word in list(dict.fromkeys(w for t in list(texts.values())[:40] for w in t.lower().split() if w.isalpha() and w.isascii()))[:300]:
        vocabulary = vocabulary or {t for t in __import__("json").load(open(WORD_BPE))["model"]["vocab"]}
        at, n = 0, 0
        while at < len(word):
            end = next(e for e in range(len(word), at, -1) if word[at:e] + ("</w>" if e == len(word) else "") in vocabulary)
            at, n = end, n + 1
        assert counter.count(word) == (1, n, 0)
    assert sum(r["n_tokens"] for r in got.values()) == sum(counter.count(t)[1] for t in texts.values()) > 0
