"""The digest filter follows the number of entries, and the runs can be asked for single digests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docketlake.llm import exact_dedup as D

from .test_llm import docs_of


def entries(spark, n):
    return spark.range(n).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))


@pytest.mark.parametrize("n", [0, 10, 5000, 60_000])
def test_filter_size_and_misses(spark, n):
    held, other = entries(spark, n), spark.range(100_000, 110_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    filt = D.block_filter(held)
    assert filt.blocks == 1024 or n * 12 / 64 <= filt.blocks < 2 * n * 12 / 64 + 1
    assert D.passing(held, filt, True).count() == n
    assert D.passing(other, filt, True).count() < 0.12 * 10_000
    assert D.passing(other, filt, False).count() + D.passing(other, filt, True).count() == 10_000


def test_without_a_filter_everything_is_joined(spark, monkeypatch):
    rows = [(k, f"t{k % 7}") for k in range(40)] + [(100, None), (101, "")]
    want = sorted(map(tuple, D.exact_dedup(docs_of(spark, rows), keep="max").collect()))
    kept = sorted(r["doc_id"] for r in D.drop_exact_copies(docs_of(spark, rows), keep="max").collect())
    monkeypatch.setattr(D.block_filter, "__defaults__", (12, 1))
    assert D.block_filter(entries(spark, 3)) == (None, 0)
    assert sorted(map(tuple, D.exact_dedup(docs_of(spark, rows), keep="max").collect())) == want
    assert sorted(r["doc_id"] for r in D.drop_exact_copies(docs_of(spark, rows), keep="max").collect()) == kept == [33, 34, 35, 36, 37, 38, 39, 101]


def test_lookup_of_single_digests(spark):
    index = D.DigestIndex(spark, "max", fan_in=2, memtables=3)
    docs = docs_of(spark, [(k, f"t{k % 50}") for k in range(200)])
    index.flush(docs.select(F.col("doc_id").alias("id"), D.digest_of(F.col("text")).alias("digest")), "id")
    asked = [hashlib.sha256(x.encode()).digest() for x in ("t7", "t49", "none")]
    found = index.lookup(asked)
    assert sorted((r["keep_id"], r["group_size"]) for r in found.collect()) == [(157, 4), (199, 4)]
    assert "In(digest" in found._jdf.queryExecution().toString() or "EqualTo(digest" in found._jdf.queryExecution().toString()


def test_ids_of_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        D.exact_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
