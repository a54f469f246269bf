"""Exact top-k inner products over vectors sorted by length.

Components become integers, so scores are exact. Vectors are range-partitioned by
descending length and packed into blocks. A rotation from the singular vectors of
all vectors (eigenvectors of their summed outer products) puts most of a product
into the first coordinates: a product is at most the partial sum over those plus the
product of the residual lengths (Cauchy-Schwarz), and a whole block is at most the
query's length times the block's longest vector. The longest vectors are seen first;
they set each query's lowest useful score, and bounds below it are pruned. What is
left gets the exact integer product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketlake.llm.common import written

EXACT = float(1 << 53)
MOST_GROUPS = 100_000  # groups of queries, each one row of what is broadcast


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, x (floor of scale * component) of the vectors that take part."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.filter(v.isNotNull() & F.col(id_col).isNotNull()).filter(finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if (size == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(n) for n in size])] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal columns, the strongest direction first; ``dim`` x ``dim`` on the driver."""

    def partial(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    cells = rows.select("x").mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    gram = np.zeros((dim, dim))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        gram[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _packed(ids: np.ndarray, m: np.ndarray) -> tuple[bytes, bytes]:
    return ids.astype(np.int64).tobytes(), m.astype(np.float64).tobytes()


def _blocks(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """(length, n, ids, data, mark): blocks of ``size`` rows in the order they come; a task's last one may be smaller."""

    def packed(held):
        ids, m = (np.concatenate(x) for x in zip(*held))
        data = _packed(ids, m)
        return pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((m * m).sum(1).max()))]), pa.array([len(ids)], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["length", "n", "ids", "data"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                held.append((part.column(0).to_numpy(), _matrix(part.column(1), dim)))
                n += part.num_rows
                at += part.num_rows
                if n == size:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return rows.select("id", "x").mapInArrow(run, "length double, n int, ids binary, data binary").withColumn("mark", F.xxhash64("ids"))


def visits(blocks: DataFrame, needs: DataFrame, slices: int) -> DataFrame:
    """(group, slice, n): the slices from which a group of queries needs blocks, and how many."""
    met = blocks.select("length", "mark").join(needs, F.col("length") >= F.col("need"))
    return met.groupBy("group", F.pmod("mark", F.lit(slices)).alias("slice")).agg(F.count(F.lit(1)).alias("n"))


def task_count(pairs: int, sent: int, block_bytes: int, group_bytes: int, cores: int, task_bytes: int = 64 << 20) -> int:
    """Tasks for the search: by the bytes that are sent, not by the pairs of groups and slices."""
    return max(1, min(pairs, max(4 * cores, -(-(sent * block_bytes + pairs * group_bytes) // task_bytes))))


class _Best:
    """The k best (score, id) of each query of a group so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, head: int, k: int, seed: tuple[np.ndarray, np.ndarray]):
        self.ids, self.q, self.k, self.head, self.turn = ids, q, k, head, turn
        self.r = q @ turn
        self.len = np.sqrt((q * q).sum(1))
        self.rest = np.sqrt((self.r[:, head:] ** 2).sum(1))
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.least = np.full(len(ids), -np.inf)
        if len(seed[0]) > k:
            s = q @ seed[1].T
            s[ids[:, None] == seed[0][None, :]] = -np.inf
            self.least = np.partition(s, -k, axis=1)[:, -k]

    def see(self, ids: np.ndarray, v: np.ndarray) -> None:
        slack = 1e-6 + 1e-9 * self.len.max() * np.sqrt((v * v).sum(1).max())
        length = np.sqrt((v * v).sum(1))
        live = np.flatnonzero(self.len * length.max() + slack >= self.least)
        if not len(live):
            return
        h = self.head
        w = v @ self.turn
        rest = np.sqrt((w[:, h:] ** 2).sum(1))
        for at in range(0, len(live), 256):
            rows = live[at : at + 256]
            bound = self.r[rows, :h] @ w[:, :h].T + self.rest[rows, None] * rest[None, :]
            may = bound + slack >= self.least[rows, None]
            cols = np.flatnonzero(may.any(0))
            if not len(cols):
                continue
            s = self.q[rows] @ v[cols].T
            s[~may[:, cols] | (self.ids[rows, None] == ids[None, cols])] = -np.inf
            s = np.concatenate([self.score[rows], s], axis=1)
            owner = np.concatenate([self.vec[rows], np.broadcast_to(ids[cols], (len(rows), len(cols)))], axis=1)
            cut = np.maximum(np.partition(s, -self.k, axis=1)[:, -self.k], self.least[rows])
            i, j = np.nonzero((s >= cut[:, None]) & (s > -np.inf))
            order = np.lexsort((owner[i, j], -s[i, j], i))
            i, j = i[order], j[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            top = place < self.k
            self.score[rows], self.vec[rows] = -np.inf, np.iinfo(np.int64).max
            self.score[rows[i[top]], place[top]] = s[i[top], j[top]]
            self.vec[rows[i[top]], place[top]] = owner[i[top], j[top]]
            self.least[rows] = np.maximum(self.least[rows], self.score[rows, -1])

    def found(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.vec[i, j]), pa.array(self.score[i, j].astype(np.int64))], names=["query_id", "vec_id", "score"])


def top_inner_products(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 1024, group: int = 2048, head: int = 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best other rows.

    ``queries`` picks the rows that are queries. Ties go to the smaller id; a query
    with fewer candidates gets all. Rows whose vector or id is null, or whose vector
    holds null or non-finite components, take no part; a vector shorter than the
    longest counts as ending in zeros. Rows with one id are candidates each, but
    never for a query of that id. Integer products must stay below 2^53.

    Query groups meet vector blocks in tasks keyed by (group, slice of the blocks);
    blocks that no query of a group can need are not sent to it, and a group is sent
    only to slices from which it needs a block. Tasks follow the bytes sent.
    """
    spark = vectors.sparkSession
    rows = written(integer_vectors(vectors, id_col, vec_col, scale).withColumn("sq", F.aggregate("x", F.lit(0.0), lambda a, b: a + b.cast("double") * b)), "vectors")
    facts = rows.agg(F.max(F.size("x")).alias("dim"), F.count(F.lit(1)).alias("n"), F.max("sq").alias("sq")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts["n"] or not facts["dim"]:
        zero = rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
        return zero.limit(0) if not facts["n"] else _all_zero(rows, queries, k, id_col)
    if facts["sq"] >= EXACT:
        raise ValueError("integer products would pass 2^53")
    dim, n = facts["dim"], facts["n"]
    head = min(head, dim)
    turn = rotation(rows, dim)
    parts = max(1, min(200, n // (4 * block)), n // (64 * block))
    by_length = rows.repartitionByRange(parts, F.desc("sq"), "id").sortWithinPartitions(F.desc("sq"), "id")
    blocks = written(_blocks(by_length, dim, block), "vector-blocks")
    chosen = rows.withColumnRenamed("id", id_col).filter(queries).withColumnRenamed(id_col, "id")
    n_asked = chosen.count()
    group = max(group, -(-n_asked // MOST_GROUPS))
    # groups of queries of like length, so that a group's need is near that of each of its queries
    chosen = chosen.repartitionByRange(max(1, n_asked // (16 * group)), F.desc("sq"), "id").sortWithinPartitions(F.desc("sq"), "id")
    asked = written(_blocks(chosen, dim, group).withColumn("group", F.monotonically_increasing_id()), "query-blocks")
    first = blocks.orderBy(F.desc("length"), F.xxhash64("ids")).limit(1).collect()
    seed = (np.frombuffer(first[0]["ids"], np.int64), np.frombuffer(first[0]["data"]).reshape(-1, dim))

    def least(batches):
        for batch in batches:
            need = []
            for ids, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                b = _Best(np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim), turn, head, k, seed)
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.where(b.len > 0, (b.least - 1e-6) / b.len, np.where(b.least > 0, np.inf, -np.inf))
                need.append(float(ratio.min()) * (1 - 1e-9 if ratio.min() > 0 else 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(need, pa.float64())], names=["group", "need"])

    # one small row for each group of queries, of which there are not many more than MOST_GROUPS
    needs = written(asked.select("group", "ids", "data").mapInArrow(least, "group long, need double"), "needs")
    if not n_asked:
        return spark.createDataFrame([], schema)
    slices = max(1, -(-blocks.count() // 16))
    visited = written(visits(blocks, needs, slices), "visits")
    total = visited.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("sent")).first()
    sent = blocks.join(needs, F.col("length") >= F.col("need")).select("group", F.pmod("mark", F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), "length", "ids", "data")
    questions = asked.join(visited.select("group", "slice"), "group").select("group", "slice", F.lit(0).alias("kind"), "length", "ids", "data")
    tasks = task_count(total["pairs"], total["sent"], 8 * dim * block, 8 * dim * group, spark.sparkContext.defaultParallelism)

    def search(batches):
        at, best = None, None
        for batch in batches:
            for g, s, kind, ids, data in zip(*(batch.column(c).to_pylist() for c in ("group", "slice", "kind", "ids", "data"))):
                ids, m = np.frombuffer(ids, np.int64), np.frombuffer(data).reshape(-1, dim)
                if kind == 0:
                    if best is not None:
                        yield best.found()
                    at, best = (g, s), _Best(ids, m, turn, head, k, seed)
                elif at == (g, s):
                    best.see(ids, m)
        if best is not None:
            yield best.found()

    dealt = sent.unionByName(questions).repartition(tasks, "group", "slice").sortWithinPartitions("group", "slice", "kind", F.desc("length"))
    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _all_zero(rows: DataFrame, queries: Column, k: int, id_col: str) -> DataFrame:
    """Only empty vectors: all scores are 0, so the smallest other ids win."""
    low = rows.select(F.col("id").alias("vec_id")).orderBy("vec_id").limit(k + 1)
    asked = rows.withColumnRenamed("id", id_col).filter(queries).select(F.col(id_col).alias("query_id"))
    pairs = asked.join(F.broadcast(low), F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.lit(0).cast("long").alias("score"))
