"""The substring index: the same rows as a scan, and few rows read."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake.functions.text import contains_query
from docketlake.operators.substring_index import SubstringIndex
from docketlake.sources.folders import new_folder


@pytest.fixture(scope="module")
def sections(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdéÜ ") for _ in range(r.randint(0, 12)))
    entry = lambda: (word(), r.choice([word(), None]))
    data = [(k, r.choice([word(), None, ""]), word(), r.choice([None, [], [entry()], [entry(), entry()]]), r.choice([None, [entry()]])) for k in range(400)]
    data.append((400, "Grüße AN Alle", "x", None, [("ab", None)]))
    kind = "array<struct<question: string, answer: string>>"
    rows = spark.createDataFrame(data, f"id int, title string, description string, content {kind}, faqs {kind}").persist()
    inside = lambda c: F.coalesce(F.flatten(F.transform(c, lambda i: F.array(i["question"], i["answer"]))), F.array().cast("array<string>"))
    texts = F.concat(F.array("title", "description"), inside(F.col("content")), inside(F.col("faqs")))
    return rows, SubstringIndex(rows, "id", texts, new_folder(spark, "substrings"))


def holds(q):
    return contains_query(q, F.col("title"), F.col("description"), F.col("content"), F.col("faqs"))


@pytest.mark.parametrize("query", ["", "a", "ab", "abc", "ABC", "dad", "grüsse", "GRÜẞE", "grüße an", "an alle", "zzz", "a b", "éü", "bcda", "   "])
def test_same_as_a_scan(sections, query):
    rows, index = sections
    want = sorted(r.id for r in rows.filter(holds(query)).collect())
    assert sorted(r.id for r in index.search(query, holds).collect()) == want


def test_few_rows_are_verified(sections):
    _, index = sections
    assert index.chosen("ab") is None and len(index.chosen("abcdabcd")) <= 4
    assert [r.key for r in index.keys(index.chosen("grüße an")).collect()] == [400]
    plan = index.search("grüße an", holds)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(piece" in plan
