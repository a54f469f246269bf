"""The vector index: exact search equals the search over all rows, probes reach their recall, lists are left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.operators import retrieval as M
from docketlake.operators import vector_index as V
from docketlake.plans.views import view
from docketlake.sources.folders import new_folder


def rows_of(df):
    return [(r["id"], round(r["similarity"], 12)) for r in df.collect()]


def built(spark, rows, **given):
    return V.build_index(rows, new_folder(spark, "test-index"), **given)


@pytest.fixture(scope="module")
def clustered(spark):
    """4,000 vectors around 40 directions, with filters' columns."""
    r = np.random.default_rng(8)
    around = r.normal(size=(40, 24))
    vectors = around[r.integers(0, 40, 4000)] + 0.35 * r.normal(size=(4000, 24))
    data = [(k, v.tolist(), int(k % 9), int(k % 4) if k % 2 else None, k % 2 == 0) for k, v in enumerate(vectors)]
    rows = spark.createDataFrame(data, "id long, embedding array<float>, document_type_id int, matter_id long, is_precedent boolean").repartition(4).persist()
    return rows, built(spark, rows)


def test_every_row_is_indexed(clustered):
    rows, index = clustered
    assert sorted(r.id for r in index.rows().select("id").collect()) == list(range(4000))
    assert index.n.sum() == 4000 and 40 < len(index.centres) <= 63


@pytest.mark.parametrize("threshold,count,filters", [(0.5, 5, {}), (0.1, 20, {}), (-1.0, 7, {}), (0.9999, 5, {}), (0.3, 5, {"filter_document_type_id": 3}), (0.2, 4, {"filter_matter_id": 1}), (0.2, 50, {"precedent_only": True})])
def test_exact_search(clustered, threshold, count, filters):
    rows, index = clustered
    for q in ([0.3] * 24, [float(k % 5) - 2 for k in range(24)], rows.filter("id = 77").first().embedding):
        assert rows_of(index.match(q, threshold, count, **filters)) == rows_of(M.match_documents(rows, q, threshold, count, **filters))


def test_lists_are_left_out(clustered):
    rows, index = clustered
    q = rows.filter("id = 77").first().embedding
    found = index.match(q, 0.5, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "list#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(angle" in plan
    _, possible = index._query(q)
    reached = min(r["similarity"] for r in found.collect())
    assert (possible >= reached - 1e-6).sum() < len(index.centres) / 3


def test_recall_of_probes(clustered):
    rows, index = clustered
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = {tuple(r) for r in M.match_documents_batch(rows, asked, 0.2, 5).select("query_id", "id").collect()}
    got = {tuple(r) for r in index.match_batch(asked, 0.2, 5, probes=3).select("query_id", "id").collect()}
    assert len(want & got) / len(want) >= 0.9


def test_batch_is_exact(clustered):
    rows, index = clustered
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    told = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.similarity, 12)) for r in df.collect())
    for threshold, count in ((0.2, 5), (0.97, 3), (-1.0, 2)):
        assert told(index.match_batch(asked, threshold, count)) == told(M.match_documents_batch(rows, asked, threshold, count))


def test_random_vectors_too(spark):
    rows = view(spark, "/root/testdata/sf0.001", "vectors")
    index = built(spark, rows)
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    told = lambda df: sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    want = told(M.match_documents_batch(rows, asked, 0.1, 5))
    assert told(index.match_batch(asked, 0.1, 5)) == want
    hit = set(want) & set(told(index.match_batch(asked, 0.1, 5, probes=len(index.centres) * 2 // 3)))
    assert len(hit) / len(want) >= 0.8


def test_rows_without_a_similarity(spark):
    data = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 2.0, 3.0]), (5, []), (6, [1.0, None]), (7, [-1.0, 0.5]), (8, [2.0, 0.0]), (9, [float("nan"), 1.0])]
    rows = spark.createDataFrame(data, "id long, embedding array<double>")
    index = built(spark, rows)
    assert sorted(r.id for r in index.rows().collect()) == list(range(1, 10))
    assert sorted(r.id for r in index.rows().filter("list = -1").collect()) == [2, 3, 4, 5, 6, 9]
    for q in ([1.0, 0.0], [1.0, 2.0, 2.0], [0.0, 0.0], [1.0]):
        assert rows_of(index.match(q, -0.5, 5)) == rows_of(M.match_documents(rows, q, -0.5, 5))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.id) for r in index.match_batch(asked, 0.5, 5).orderBy("rank").collect()] == [(1, 1), (1, 8)]


def test_no_rows_and_one_list(spark):
    rows = spark.createDataFrame([], "id long, embedding array<double>")
    index = built(spark, rows)
    assert index.match([1.0, 2.0], 0.1, 5).count() == 0
    same = spark.range(300).selectExpr("id", "array(1D, 2D) AS embedding")
    index = built(spark, same)
    assert rows_of(index.match([1.0, 2.0], 0.5, 3)) == rows_of(M.match_documents(same, [1.0, 2.0], 0.5, 3))


def test_rows_added_later(clustered, spark):
    rows, _ = clustered
    index = built(spark, rows.filter("id % 3 > 0"))
    index.add(rows.filter("id % 3 = 0"))
    again = V.VectorIndex(spark, index.path)
    assert again.n.sum() == 4000
    q = rows.filter("id = 78").first().embedding
    assert rows_of(again.match(q, 0.2, 9)) == rows_of(M.match_documents(rows, q, 0.2, 9))


def test_names_that_clash_are_refused(spark):
    with pytest.raises(ValueError, match="angle"):
        built(spark, spark.range(3).selectExpr("id", "array(1D) AS embedding", "1 AS angle"))
