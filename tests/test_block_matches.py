"""Batch search by blocks: the matches of a plain scan, also with copies, many blocks and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketlake.functions.vector import cosine
from docketlake.operators import retrieval as M
from docketlake.operators import vector_index as V
from docketlake.sources.folders import new_folder


def scan(chunks, asked, threshold, count):
    met = chunks.crossJoin(asked.select("query_id", F.col("embedding").alias("q")))
    scored = met.select("query_id", "id", cosine(F.col("embedding"), F.col("q")).alias("similarity")).filter(F.col("similarity") > threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return told(scored.withColumn("rank", rank).filter(F.col("rank") <= count))


def told(df):
    return sorted((r.query_id, r["rank"], r.id, r.similarity) for r in df.collect())


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    around = r.normal(size=(12, 16))
    vectors = [(around[k % 12] + 0.5 * r.normal(size=16)).tolist() for k in range(600)]
    vectors[100:200] = [vectors[7]] * 100  # copies
    vectors[200:230] = [[2 * x for x in vectors[9]]] * 30  # another length, the same direction
    odd = [None, [], [1.0, 2.0], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1e200] * 16, [1.0, -2.0]]
    data = list(enumerate(vectors + odd))
    return spark.createDataFrame(data[::-1], "id long, embedding array<double>").repartition(5).persist()


@pytest.mark.parametrize("threshold, count", [(0.2, 5), (-2.0, 3), (0.95, 200)])
def test_same_numbers_as_a_scan(rows, threshold, count):
    asked = rows.filter("id % 20 = 7 OR id >= 598").select(F.col("id").alias("query_id"), "embedding")
    want = scan(rows, asked, threshold, count)
    for given in ({}, {"slices": 3, "rows_per_bucket": 40}):
        assert told(M.match_documents_batch(rows, asked, threshold, count, **given)) == want


@pytest.mark.parametrize("rows_per_block, per_slice", [(20_000, 4_000), (30, 10)])
def test_index_has_the_same_numbers(spark, rows, rows_per_block, per_slice):
    usual = rows.filter("id < 606")
    index = V.build_index(usual, new_folder(spark, "test-blocks"), length=16)
    asked = usual.filter("id % 20 = 7").select(F.col("id").alias("query_id"), "embedding")
    for threshold, count in ((0.2, 5), (0.9, 40)):
        assert told(index.match_batch(asked, threshold, count, rows_per_block=rows_per_block, queries_per_slice=per_slice)) == scan(usual.filter("size(embedding) = 16"), asked, threshold, count)


def test_pairs_are_left_to_no_expression(rows):
    asked = rows.select(F.col("id").alias("query_id"), "embedding")
    plan = M.match_documents_batch(rows, asked, 0.2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


def test_blocks_of_lists():
    start, parts = V._blocks(np.array([5, 5, 5, 25, 0, 9, 2]), 10)
    assert start.tolist() == [0, 0, 1, 2, 5, 5, 6] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1]
    assert V._blocks(np.array([3, 0, 4]), 10, apart=True)[0].tolist() == [0, 1, 2]
    assert len(V._blocks(np.zeros(0, np.int64), 10)[0]) == 0
