"""Queries over whole tables: every row is in the result, however large the table."""

import pytest
from pyspark.sql import functions as F

from docketlake.operators import relational as R
from docketlake.operators import retrieval as M
from docketlake.plans.queries import QUERIES
from docketlake.plans.views import view

from .conftest import SF


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_every_matter_gets_a_context(spark):
    got = QUERIES["draft_context"](spark, SF)
    assert ids(got) == ids(view(spark, SF, "matters"))
    assert got.filter("id >= 1000").count() > 0 and got.filter("context IS NULL").count() == 0


@pytest.mark.parametrize("name, table", [("matters_list", "matters"), ("clients_sorted", "clients"), ("profiles_nulls_last", "profiles")])
def test_every_row_has_a_position(spark, name, table):
    got = QUERIES[name](spark, SF)
    assert ids(got) == ids(view(spark, SF, table))
    assert ids(got, "position") == list(range(1, got.count() + 1))


@pytest.mark.parametrize("rows_per_range", [20, 60, 100_000])
def test_positions_like_sorting(spark, rows_per_range):
    names = [None if i % 7 == 0 else f'n{i * 7919 % 50}"é,' if i % 3 else "" for i in range(600)]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(5)
    got = {r["id"]: r["position"] for r in R.positions(rows, [F.col("name").isNull(), F.col("name"), -F.col("id")], rows_per_range=rows_per_range).collect()}
    want = sorted(range(600), key=lambda i: (names[i] is None, (names[i] or "").encode(), -i))
    assert got == {i: n for n, i in enumerate(want, 1)}
    first = {r["id"]: r["position"] for r in R.positions(rows, [F.col("name"), F.col("id")], rows_per_range=rows_per_range).collect()}
    want = sorted(range(600), key=lambda i: (names[i] is not None, (names[i] or "").encode(), i))
    assert first == {i: n for n, i in enumerate(want, 1)}
    assert R.positions(rows.filter("id < 0"), [F.col("id")]).count() == 0


def test_every_client_is_looked_up(spark):
    sf_dir = "/root/testdata/sf0.01"  # more than 300 clients
    got = QUERIES["find_or_create"](spark, sf_dir)
    assert set(ids(view(spark, sf_dir, "clients"))) <= set(ids(got, "matter_id"))


@pytest.mark.parametrize("name", ["version_context", "upload_paths"])
def test_every_version_is_taken(spark, name):
    held = ("matter_document_id", "version_number")
    got, want = QUERIES[name](spark, SF).select(*held), view(spark, SF, "document_versions").select(*held)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_slices_grow_with_the_queries(spark):
    rows = spark.range(900).selectExpr("id", "array(double(id % 7 + 1), double(id % 5)) AS embedding")
    queries = rows.selectExpr("id AS query_id", "embedding")
    few, many = (M.match_documents_batch(rows, queries, 0.2, 2, **given) for given in ({"slices": 1}, {"rows_per_slice": 30}))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert "cast(29 as bigint)" in many._jdf.queryExecution().analyzed().toString()


def test_precedents_by_type_gather_no_ids(spark):
    assert "collect_list" not in QUERIES["precedent_by_type"](spark, SF)._jdf.queryExecution().analyzed().toString()


def test_pages_of_a_large_group(spark):
    rows = spark.createDataFrame([(None if k % 10 == 0 else "hot" if k % 10 < 8 else "cold", k) for k in range(500)], "label string, id int").repartition(4)
    pages = R.grouped_pages(rows, F.col("label"), "label", F.col("id"), [-F.col("id")], size=40)
    got = sorted(((r.label or "", r.page, list(r["items"]), r.n) for r in pages.collect()))
    want = []
    for label, keep in (("", lambda k: k % 10 == 0), ("cold", lambda k: k % 10 >= 8), ("hot", lambda k: 0 < k % 10 < 8)):
        ids = [k for k in reversed(range(500)) if keep(k)]
        want += [(label, at // 40, ids[at : at + 40], len(ids)) for at in range(0, len(ids), 40)]
    assert got == want and R.grouped_pages(rows.limit(0), F.col("label"), "label", F.col("id"), [F.col("id")]).count() == 0
