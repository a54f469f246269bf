"""Ranked search against a plain reading of its contract."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.llm import lexical_search as ls
from docketlake.llm.queries import OP13_SQL, queries

from ..conftest import SF
from .test_llm import awkward, docs_of, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(d, Counter(words(t))) for d, t in docs]
    n_docs, all_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c in counts:
            if d is None or not c:
                continue
            m = 100 - 90 + (90 * c.total() * n_docs) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, 3, "z") for i, t in rows], "item_id long, text string, rank long, term string")


def test_query_is_the_definition(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(queries()["op13_lexical_search"](spark, SF)) == brute(docs, items)


def test_same_as_sql(spark, duck):
    got = found(queries()["op13_lexical_search"](spark, SF).select("item_id", "rank", "doc_id", "score"))
    assert got == sorted(duck.execute(OP13_SQL).fetchall())


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    items = [(1, "one TWO three"), (1, "w5"), (2, None), (3, "!!"), (None, "one"), (4, "éÈ 中文"), (5, "x" * 5000), (6, "End w1 w2 w3"), (7, "nowhere")]
    assert found(ls.ranked_search(df, items_of(spark, items))) == brute(rows, items)
    assert found(ls.ranked_search(empty(spark), items_of(spark, items))) == []
    assert found(ls.ranked_search(df, items_of(spark, []))) == []
    assert found(ls.ranked_search(docs_of(spark, [(1, "?"), (2, None)]), items_of(spark, items))) == []


def test_blocks_and_ties(spark):
    rows = [(d, f"same words here {'and more ' * (d % 3)}") for d in range(40)] + [(5, "same words here"), (7, "other")]
    items = [(k, f"words more w{k} other") for k in range(9)]
    want = brute(rows, items, 3)
    df = docs_of(spark, rows).repartition(5)
    assert found(ls.ranked_search(df, items_of(spark, items), 3, terms_at_once=9)) == want
    assert ls._blocks(ls.item_terms(items_of(spark, items)), 9) > 1
    assert found(ls.ranked_search(df, items_of(spark, items), 3)) == want


def test_string_item_ids(spark):
    items = items_of(spark, [(3, "same")]).withColumn("item_id", F.lit("b-3"))
    assert found(ls.ranked_search(docs_of(spark, [(1, "the same"), (2, "x")]), items))[0][:3] == ("b-3", 1, 1)


@pytest.mark.parametrize("span", [3, 8, 50])
def test_parts_of_long_texts(monkeypatch, span):
    text = "Éa bb  ccc-bb\nBB bbb abb bb" * 9
    scanner = ls.TermScanner([w.encode() for w in ("bb", "ccc", "éa", "Éa", "b")])
    whole = scanner.scan(text.encode())
    want = Counter(words(text))
    assert whole == (want.total(), {0: want["bb"], 1: want["ccc"], 3: want["Éa"]})
    monkeypatch.setattr(ls, "SPAN", span)
    assert scanner.scan(text.encode()) == whole


def test_best_of_many_blocks():
    r = np.random.default_rng(3)
    best, rows = ls._Best(4, 3), []
    for at in range(0, 4000, 100):
        scores, ids = r.integers(0, 50, (100, 4)), np.arange(at, at + 100)[::-1]
        best.add(scores, ids)
        rows += [(i, -int(s), int(d)) for d, row in zip(ids, scores) for i, s in enumerate(row) if s]
    item, score, ids = best.cut()
    assert list(zip(item.tolist(), (-score).tolist(), ids.tolist())) == [x for i in range(4) for x in sorted(y for y in rows if y[0] == i)[:3]]
