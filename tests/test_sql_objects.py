"""Functions and guarded views in SQL: the same rows as the operators give, filters at the scan."""

import pytest
from pyspark.sql import functions as F

from docketlake.operators import retrieval as M
from docketlake.operators import security as S
from docketlake.plans import sql_objects as Q
from docketlake.plans.views import view

from .conftest import SF


@pytest.fixture(scope="module")
def tables(spark):
    t = {n: view(spark, SF, n) for n in ("vectors", "profiles", "user_roles", "clients", "matters", "document_types")}
    Q.define_functions(spark, t["vectors"], t["profiles"], t["user_roles"])
    t["support_requests"] = t["matters"].select("id", F.col("client_id").alias("user_id"))
    guarded = {k: v for k, v in t.items() if k in S.RULES}
    assert len(Q.define_guarded(spark, guarded)) == 3 * len(guarded)
    return t


def rows_of(df):
    return [(r["id"], round(r["similarity"], 12)) for r in df.collect()]


@pytest.mark.parametrize("sql,given", [("", {}), (", filter_matter_id => 7", {"filter_matter_id": 7}), (", filter_document_type_id => 3", {"filter_document_type_id": 3}), (", precedent_only => true", {"precedent_only": True}), (", 7, 3, true", {"filter_matter_id": 7, "filter_document_type_id": 3, "precedent_only": True})])
def test_match_documents_in_sql(spark, tables, sql, given):
    q = tables["vectors"].filter("id = 7").first().embedding
    got = spark.sql(f"SELECT id, similarity FROM match_documents((SELECT CAST(embedding AS ARRAY<DOUBLE>) FROM chunk_rows WHERE id = 7), 0.05D, 4{sql}) ORDER BY similarity DESC, id")
    assert rows_of(got) == rows_of(M.match_documents(tables["vectors"], q, 0.05, 4, **given))


def test_arguments_have_defaults_and_odd_ones_give_no_rows(spark, tables):
    assert [r["id"] for r in spark.sql("SELECT id FROM match_documents((SELECT CAST(embedding AS ARRAY<DOUBLE>) FROM chunk_rows WHERE id = 7))").collect()] == [7]
    for q in ("array(1D)", "array_repeat(0D, 64)", "CAST(NULL AS ARRAY<DOUBLE>)"):
        assert spark.sql(f"SELECT * FROM match_documents({q}, -1D)").count() == 0
    assert spark.sql("SELECT * FROM match_documents(array_repeat(1D, 64), -1D, 0)").count() == 0


def test_filters_reach_the_scan(spark, tables):
    plan = spark.sql("SELECT * FROM match_documents(array_repeat(1D, 64), 0D, 5, filter_document_type_id => 3)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan.split("PushedFilters: ")[1] and "matter_id" not in plan.split("PushedFilters: ")[1] and "TakeOrdered" in plan


def test_predicates(spark, tables):
    got = spark.sql("SELECT is_firm_member(3), is_firm_member(-1), is_firm_member(NULL), has_role(8, 'admin'), has_role(8, 'partner'), has_role(NULL, 'admin')").first()
    assert tuple(got) == (True, False, False, True, False, False)


@pytest.mark.parametrize("user", [None, -1, 2, 3, 5, 8, 9])
def test_views_follow_the_rules(spark, tables, user):
    Q.as_user(spark, user)
    for table in ("profiles", "user_roles", "clients", "matters", "document_types", "support_requests"):
        for action in ("select", "update", "delete"):
            want = S.secure(tables[table], table, user, tables["profiles"], tables["user_roles"], action)
            assert spark.table(f"{action}_{table}").count() == want.count(), (table, action)
        want = S.secure(tables[table], table, user, tables["profiles"], tables["user_roles"], "insert")
        assert Q.insertable(table, tables[table]).count() == want.count(), table


def test_a_query_keeps_its_user(spark, tables):
    Q.as_user(spark, 3)
    before = spark.table("select_clients")
    Q.as_user(spark, None)
    assert before.count() == tables["clients"].count() and spark.table("select_clients").count() == 0


def test_nobody_reads_nothing(spark, tables):
    Q.as_user(spark, None)
    plan = spark.sql("SELECT * FROM update_profiles")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.strip().startswith("LocalRelation <empty>")


def test_tables_without_rules_are_refused(spark, tables):
    with pytest.raises(ValueError, match="no rules"):
        Q.define_guarded(spark, {"other": tables["clients"]})
