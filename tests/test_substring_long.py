"""The substring index over long texts, and what its postings hold."""

import time

from pyspark.sql import functions as F

from docketlake.operators.substring_index import SubstringIndex
from docketlake.sources.folders import new_folder

from .test_substring_index import sections  # noqa: F401


def test_long_texts_take_one_pass(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(300_000)) + " Needle 😀é"
    rows = spark.createDataFrame([(1, long), (2, "no"), (3, None), (4, "needle 😀É"), (5, "x" * 100)], "id int, title string")
    start = time.time()
    index = SubstringIndex(rows, "id", F.array("title"), new_folder(spark, "substrings"))
    found = lambda q: sorted(r.id for r in index.search(q, lambda q: F.coalesce(F.lower("title").contains(q.lower()), F.lit(False))).collect())
    assert found("NEEDLE 😀é") == [1, 4] and found("xxx") == [5] and found("zq😀") == []
    assert time.time() - start < 60  # a work of the square of the length takes many minutes


def test_postings_hold_each_row_once(sections):
    rows, index = sections
    held = index.postings().groupBy("piece", "key").count()
    assert held.filter("count > 1").count() == 0 and held.count() == index._read("counts", "n long").agg(F.sum("n")).first()[0]
