"""Threads, ids, uploads and stores beside their queries."""

import pytest
from pyspark.sql import functions as F

from docketlake.functions import text as T
from docketlake.operators import changes as C
from docketlake.operators import chat as H
from docketlake.sources.extract import allowed, fetch, files
from docketlake.sources.store import SnapshotStore

NOW = "timestamp_seconds(0)"


def test_a_request_that_comes_again_changes_nothing(spark):
    threads = spark.createDataFrame([("t1", "m1", "Old")], "id string, matter_id string, title string")
    messages = spark.createDataFrame([], "id string, thread_id string, role string, content string, created_at timestamp")
    asked = spark.createDataFrame([(1, "t1", "m1", "u", "q1", "a1"), (2, None, "m2", "u", "q2", None), (3, None, None, "u", "q3", "a3"), (4, "t1", None, "u", "q4", "a4")], "request_id long, thread_id string, matter_id string, user_id string, question string, reply string")
    for _ in range(2):
        threads, requests = H.resolve_threads(threads, asked, F.expr(NOW), H.intake_title(F.lit("EPC Contract")))
        messages = H.append_turns(messages, requests, F.expr(NOW))
    by = {r["request_id"]: r["thread_id"] for r in requests.collect()}
    assert by[1] == "t1" and by[3] is None and by[4] is None and len(by[2]) == 36
    assert sorted((r["id"], r["title"]) for r in threads.collect()) == sorted([("t1", "Old"), (by[2], "Draft intake: EPC Contract")])
    turns = [(r["thread_id"], r["role"], r["content"]) for r in messages.orderBy("thread_id", "created_at").collect()]
    assert sorted(turns[-2:]) == sorted([("t1", "user", "q1"), ("t1", "assistant", "a1")]) and turns.index(("t1", "user", "q1")) < turns.index(("t1", "assistant", "a1"))
    assert len(turns) == 3 and (by[2], "user", "q2") in turns


def test_ids_follow_from_keys(spark):
    new = spark.createDataFrame([("a", None), ("b", "own"), (None, None)], "name string, id string")
    got = {r["name"]: r["id"] for r in C.with_ids(new, "clients", ["name"]).collect()}
    assert got["b"] == "own" and len({*got.values()}) == 3
    assert got == {r["name"]: r["id"] for r in C.with_ids(new.repartition(3), "clients", ["name"]).collect()}
    made = C.find_or_create(new.limit(0), new.select("name"), ["name"], {}, "clients")
    assert made.filter("id IS NULL").count() == 0 and made.count() == 3


def test_only_tables_that_keep_it_are_touched(spark):
    rows = spark.createDataFrame([("1", "x")], "id string, status string").withColumn("updated_at", F.expr(NOW))
    later = F.timestamp_seconds(F.lit(60))
    of = lambda table: C.update_table(table, rows, F.lit(True), {"status": F.lit("y")}, later).selectExpr("status", "unix_timestamp(updated_at) AS t").first()
    assert tuple(of("matters")) == ("y", 60) and tuple(of("matter_stages")) == ("y", 0)


def test_names_dates_and_missing_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.PDF",), ("b.doc",), ("",), (None,)], "name string")
    assert [r[0] for r in rows.select(allowed(F.col("name"))).collect()] == [True, False, False, False]
    assert spark.range(1).select(T.locale_date(F.lit("2024-03-07").cast("date"))).first()[0] == "3/7/2024"
    (tmp_path / "x.docx").write_bytes(b"d")
    stored = files(spark, f"file://{tmp_path}")
    there = stored.first()["path"]
    got = {r["path"]: (r["content"], r["error"]) for r in fetch(stored, spark.createDataFrame([(there,), ("gone",)], "path string")).collect()}
    assert bytes(got[there][0]) == b"d" and got[there][1] is None and got["gone"] == (None, "Object not found: gone")


def test_the_second_of_two_writers_fails(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    row = lambda i: spark.range(1).select(F.lit(i).alias("id"), F.lit(i).alias("user_id"), F.lit("admin").alias("role"), F.expr(NOW).alias("created_at"))
    store.write("user_roles", row("1"))
    v = store.version("user_roles")
    store.write("user_roles", C.insert(store.read("user_roles"), row("2")), after=v)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store.write("user_roles", C.insert(store.read("user_roles"), row("3")), after=v)
    assert sorted(r["id"] for r in store.read("user_roles").collect()) == ["1", "2"] and store.version("user_roles") == 2
