"""How blocks and groups of queries are dealt: only where they are needed, tasks by bytes."""

import numpy as np
from pyspark.sql import functions as F

from docketlake.llm import top_k


def vectors(spark, n, spread):
    r = np.random.default_rng(n)
    m = r.normal(size=(n, 6)) * (r.random((n, 1)) ** spread)
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(3)


def test_blocks_fill_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = top_k.integer_vectors(vectors(spark, 100, 1), "vec_id", "embedding", 256).coalesce(1)
    got = [r.n for r in top_k._blocks(rows, 6, 30).collect()]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [30, 30, 30, 10]


def test_groups_go_only_where_blocks_go(spark):
    blocks = spark.createDataFrame([(float(10 * k), k) for k in range(20)], "length double, mark long")
    needs = spark.createDataFrame([(0, 185.0), (1, 0.0), (2, 500.0)], "group long, need double")
    got = {(r.group, r.slice): r.n for r in top_k.visits(blocks, needs, 5).collect()}
    assert got == {(0, 4): 1} | {(1, s): 4 for s in range(5)}


def test_tasks_follow_the_bytes():
    per = 64 << 20
    assert top_k.task_count(0, 0, 1, 1, 8) == 1
    assert top_k.task_count(8_000_000, 1000, 1 << 20, 0, 8) == 32
    assert top_k.task_count(8_000_000, 64_000, 1 << 20, 0, 8) == 64_000 * (1 << 20) // per
    assert top_k.task_count(5, 10**6, 1 << 20, 0, 8) == 5


def test_many_groups_and_slices_give_the_same(spark):
    df = vectors(spark, 3000, 4)
    x = {r.vec_id: np.floor(256 * np.array(r.embedding)) for r in df.collect()}
    m, ids = np.stack([x[k] for k in range(3000)]), np.arange(3000)
    got = top_k.top_inner_products(df, F.col("vec_id") % 50 == 0, block=32, group=8, head=3)
    want = []
    for q in range(0, 3000, 50):
        s = m @ m[q]
        order = [k for k in np.lexsort((ids, -s)) if k != q][:5]
        want += [(q, n, int(k), int(s[k])) for n, k in enumerate(order, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
