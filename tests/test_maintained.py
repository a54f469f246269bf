"""Results that follow changes: equal to recomputation after random inserts, updates and deletes."""

import random

import pytest
from pyspark.sql import functions as F

from docketlake.operators import maintained as D
from docketlake.operators import relational as R

SCHEMA = "id long, k string, v int, status string"


def order():
    return [F.desc("v"), F.asc("id"), F.asc("status")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_follows_random_changes(spark, seed):
    r = random.Random(seed)
    new = lambda i: (i, r.choice(["a", "b", "c", None]), r.randint(0, 9), r.choice(["active", "closed", None]))
    table = [new(i) for i in range(40)]
    before = spark.createDataFrame(table, SCHEMA)
    active = {"active": F.col("status") == "active"}
    counts, latest = D.counts(before, ["k"], **active), R.latest(before, ["k"], order())
    for step in range(2):
        kept = [x for x in table if r.random() > 0.2]
        table = [new(x[0]) if r.random() < 0.2 else x for x in kept] + [new(100 * (step + 1) + i) for i in range(6)]
        table = [x for x in table if not (step and x[1] == "c")] + table[:2]  # a key goes, rows repeat
        after = spark.createDataFrame(table, SCHEMA)
        changed = D.changes(before, after)
        counts = spark.createDataFrame(D.updated_counts(counts, changed, ["k"], **active).collect(), counts.schema)
        latest = spark.createDataFrame(D.updated_latest(latest, changed, after, ["k"], order()).collect(), SCHEMA)
        assert rows(counts) == rows(D.counts(after, ["k"], **active))
        assert rows(latest) == rows(R.latest(after, ["k"], order()))
        before = after


def test_only_lost_keys_are_read_again(spark):
    before = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "x"), (3, "b", 5, "x")], SCHEMA)
    after = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "x"), (3, "b", 5, "x"), (4, "b", 7, "x")], SCHEMA)
    refused = after.withColumn("v", F.raise_error(F.lit("read")).cast("int"))
    out = D.updated_latest(R.latest(before, ["k"], order()), D.changes(before, after), refused, ["k"], order())
    assert rows(out) == [(2, "a", 2, "x"), (4, "b", 7, "x")]


def test_no_changes(spark):
    before = spark.createDataFrame([(1, "a", 1, "x")], SCHEMA)
    assert D.changes(before, before).count() == 0
    assert rows(D.updated_counts(D.counts(before, ["k"]), D.changes(before, before), ["k"])) == [("a", 1)]
