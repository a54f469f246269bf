"""An index of vectors for cosine search: inverted lists around centres, as Parquet partitions.

Every row with a vector of the index's length lies in the list of its nearest centre,
with its angle to it. An angle is a distance, so for a query at angle t from a centre
no row at angle a can be nearer to the query than |t - a|: a list whose rows lie
between angles ``lo`` and ``hi`` can be left out once its best possible similarity is
too small. Lists are partitions and their files are sorted by angle, so what is left
out is not read: the bounds become filters on the partition and the angle column.

Exact search reads the nearest lists first, takes the similarity of the k-th match,
and then reads only what can still reach it. With ``probes`` it reads that many lists
and stops. Rows without a similarity (null or zero vectors, other lengths) are in a
list of their own, which only queries of another length read.

Centres come from spherical k-means over at most ``sample`` rows, picked by a hash of
the id; all rows are indexed. They are at most ``centre_bytes`` together, which bounds
what is broadcast and held by the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.vector import norm
from docketlake.operators import retrieval as M
from docketlake.sources.folders import new_folder, remove_folder

SAMPLE, CENTRE_BYTES = 20_000, 16 << 20
OTHER = -1  # the list of rows that have no similarity to queries of the index's length
SLACK = 1e-6  # radians and similarities; far above the rounding of either


def unit(vectors: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(size > 0, size, 1)


def centres_of(vectors: np.ndarray, n: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """At most ``n`` unit centres of unit vectors; an empty centre moves to a vector far from its own."""
    r = np.random.default_rng(seed)
    at = unit(vectors[np.sort(r.choice(len(vectors), min(n, len(vectors)), replace=False))])
    for _ in range(rounds):
        near = vectors @ at.T
        own = near.argmax(1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, vectors)
        lost = np.flatnonzero(np.linalg.norm(sums, axis=1) < 1e-9)
        if len(lost):
            sums[lost] = vectors[np.argsort(near.max(1), kind="stable")[: len(lost)]]
        at = unit(sums)
    return np.unique(at, axis=0)


def _angles(similarity: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(similarity, -1.0, 1.0))


class VectorIndex:
    """An index under a folder: ``lists`` (rows by list), ``centres`` and ``bounds``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()
        self.centres = np.array([r["centre"] for r in rows], np.float64) if rows else np.zeros((0, 0))
        self.columns = spark.read.parquet(f"{self.path}/columns").schema
        self._read_bounds()

    def _read_bounds(self) -> None:
        held = self.spark.read.schema("list int, n long, lo double, hi double").parquet(f"{self.path}/bounds")
        rows = held.filter("list >= 0").groupBy("list").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        k = len(self.centres)
        self.n, self.lo, self.hi = np.zeros(k, np.int64), np.full(k, np.inf), np.full(k, -np.inf)
        for r in rows:
            self.n[r["list"]], self.lo[r["list"]], self.hi[r["list"]] = r["n"], r["lo"], r["hi"]

    @property
    def length(self) -> int:
        """The length of the vectors that have lists."""
        return self.centres.shape[1] if len(self.centres) else 0

    def rows(self) -> DataFrame:
        """All rows with their list and angle."""
        return self.spark.read.schema(self.columns).parquet(f"{self.path}/lists")

    def _query(self, query: Sequence[float]) -> tuple[np.ndarray, np.ndarray] | None:
        """(angles of the query to the centres, best possible similarity of each list)."""
        q = np.array([float(x) for x in query])
        if len(q) != self.length or not np.isfinite(q).all() or not q.any():
            return None
        t = _angles(self.centres @ (q / np.linalg.norm(q)))
        return t, _best_possible(t, self.lo, self.hi)

    def _pruned(self, t: np.ndarray, lists: np.ndarray, least: float) -> DataFrame:
        """Rows of the lists at angles where a similarity of ``least`` can be reached."""
        reach = math.acos(min(1.0, max(-1.0, least))) + SLACK
        spans = [(F.col("list") == int(k)) & F.col("angle").between(float(t[k] - reach), float(t[k] + reach)) for k in lists]
        where = F.col("list").isin([int(k) for k in lists])
        # each list's own span of angles while the condition stays short; with more lists the partitions alone are cut
        if len(spans) <= 64:
            any_of = spans[0] if spans else F.lit(False)
            for s in spans[1:]:
                any_of |= s
            where &= any_of
        return self.rows().filter(where)

    def match(self, query: Sequence[float], match_threshold: float = M.MATCH_THRESHOLD, match_count: int = M.MATCH_COUNT, probes: int | None = None, first: int = 4, **filters) -> DataFrame:
        """``match_documents`` over the index.

        Without ``probes`` the rows are those of the search over all rows. A search first
        reads ``first`` lists; filters (as of ``match_documents``) apply in both steps.
        """
        found = self._query(query)
        if found is None:
            return self._shown(M.match_documents(self.rows().filter(F.col("list") == OTHER), query, match_threshold, match_count, **filters))
        t, possible = found
        order = np.argsort(-possible, kind="stable")
        able = order[possible[order] + SLACK > match_threshold]
        near = able[: probes if probes is not None else first]
        best = M.match_documents(self._pruned(t, near, match_threshold), query, match_threshold, match_count, **filters)
        if probes is not None or len(near) == len(able):
            return self._shown(best)
        # bounded rows: the first matches
        reached = [r["similarity"] for r in best.select("similarity").collect()]
        least = min(reached) if len(reached) == match_count else match_threshold
        left = able[possible[able] + SLACK >= least]
        return self._shown(M.match_documents(self._pruned(t, np.union1d(left, near), least), query, match_threshold, match_count, **filters))

    def _shown(self, found: DataFrame) -> DataFrame:
        return found.drop("list", "angle")

    def match_batch(self, queries: DataFrame, match_threshold: float = M.MATCH_THRESHOLD, match_count: int = M.MATCH_COUNT, probes: int | None = None, first: int = 4, rows_per_block: int = 20_000, queries_per_slice: int = 4_000) -> DataFrame:
        """Top matches of many query rows (query_id, embedding): query_id, id, similarity, rank.

        Lists lie in blocks of about ``rows_per_block`` rows, and a list with more rows in
        some blocks of its own. A query goes once to each block with a list that it has to
        read; blocks are searched as ``match_documents_batch`` does. Without ``probes``
        there are two rounds, as in ``match``: what the first finds bounds the second.
        With ``probes`` every list is a block at least, so no others are read. Queries of
        another length, and null and zero vectors, have no matches.
        """
        M._checked(match_threshold, match_count)
        asked = queries.select("query_id", "embedding").filter(F.size("embedding") == self.length)
        start, parts = _blocks(self.n, rows_per_block, apart=probes is not None)
        slices = max(1, -(-asked.count() // queries_per_slice))
        held = self._blocked(start, parts, slices, match_count)
        scored = lambda visits: M.block_matches(held, visits, ["block", "slice"], match_threshold, match_count)
        visits = lambda asked, done, stop: self._visits(asked, match_threshold, done, stop, start, parts, slices)
        if probes is not None:
            return M.ranked(scored(visits(asked, 0, probes)), match_threshold, match_count)
        folder = new_folder(self.spark, "index-matches")
        found = M.ranked(scored(visits(asked, 0, first)), match_threshold, match_count)
        found.write.parquet(folder)
        early = self.spark.read.schema(found.schema).parquet(folder)
        reached = early.filter(F.col("rank") == match_count).select("query_id", F.col("similarity").alias("least"))
        late = scored(visits(asked.join(reached, "query_id", "left"), first, None))
        return M.ranked(late.unionByName(early.drop("rank")), match_threshold, match_count)

    def _blocked(self, start: np.ndarray, parts: np.ndarray, slices: int, count: int) -> DataFrame:
        """The rows that can match (id, embedding, norm) by block, once for each slice of queries."""
        placed = self.spark.createDataFrame([(k, int(a), int(n)) for k, (a, n) in enumerate(zip(start, parts))], "list int, start int, parts int")
        rows = self.rows().select("id", "embedding", "list").join(F.broadcast(placed), "list")  # leaves out rows without a similarity
        rows = M.nearest_ids(rows, count).withColumn("norm", norm(F.col("embedding")))
        block = (F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
        return rows.select("id", "embedding", "norm", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def _visits(self, asked: DataFrame, threshold: float, done: int, stop: int | None, start: np.ndarray, parts: np.ndarray, slices: int) -> DataFrame:
        """A row a query and block: those of the places ``done`` to ``stop`` among its best lists.

        Lists that cannot pass the threshold, or reach ``least`` where it is given, are left
        out, and so are the blocks of the first ``done`` lists, which were read.
        """
        if "least" not in asked.columns:
            asked = asked.withColumn("least", F.lit(None).cast("double"))
        centres, lo, hi = self.spark.sparkContext.broadcast(self.centres), self.lo, self.hi
        blocks = int((start + parts).max()) if len(start) else 0

        def places(row: np.ndarray, lists: np.ndarray) -> np.ndarray:
            """row * blocks + block of each block of the lists."""
            n = parts[lists]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return np.unique(np.repeat(row * blocks + start[lists], n) + within)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), step := max(1, (1 << 21) // max(1, len(lo)))):
                    batch = whole.slice(at, step)
                    q = _matrix(batch.column("embedding"))
                    size = np.linalg.norm(q, axis=1)
                    good = np.flatnonzero(np.isfinite(size) & (size > 0))
                    if not len(good):
                        continue
                    possible = _best_possible(_angles((q[good] / size[good, None]) @ centres.value.T), lo, hi)
                    order = np.argsort(-possible, axis=1, kind="stable")[:, :stop]
                    value = np.take_along_axis(possible, order, 1) + SLACK
                    least = batch.column("least").to_numpy(zero_copy_only=False).astype(np.float64)[good]
                    able = (value > threshold) & ~(value < least[:, None])  # a missing least drops nothing
                    row, col = np.nonzero(able[:, done:])
                    wanted = places(row, order[row, col + done])
                    row, col = np.nonzero(value[:, :done] > threshold)
                    wanted = np.setdiff1d(wanted, places(row, order[row, col]), assume_unique=True)
                    for a in range(0, len(wanted), 4096):  # a query's vector is sent to each of its blocks
                        row, block = np.divmod(wanted[a : a + 4096], blocks)
                        sent = batch.select(["query_id", "embedding"]).take(pa.array(good[row]))
                        yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(block.astype(np.int32))], names=["query_id", "q", "block"])

        kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
        sent = asked.select("query_id", "embedding", "least").mapInArrow(run, f"query_id {kinds['query_id']}, q {kinds['embedding']}, block int")
        return sent.withColumns({"q_norm": norm(F.col("q")), "slice": F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("int")})

    def add(self, rows: DataFrame) -> None:
        """New rows under the centres there are; bounds widen before the rows are there."""
        _write(self.spark, self.path, rows, self.centres)
        self._read_bounds()


def _best_possible(t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The cosine of the smallest angle that a list's rows can have to a query at angle ``t``; empty lists: -2."""
    gap = np.maximum(0.0, np.maximum(t - hi, lo - t))
    return np.where(np.isfinite(gap), np.cos(np.minimum(gap, math.pi)), -2.0)


def _blocks(n: np.ndarray, rows: int, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each list: lists in order fill blocks of about ``rows``.

    A list with more rows has blocks of its own; with ``apart`` every list has.
    """
    start, parts = np.zeros(len(n), np.int64), np.maximum(1, -(-n // rows))
    at, room = -1, 0
    for k, size in enumerate(n):
        if apart or parts[k] > 1 or size > room:
            at, room = at + 1, rows
        start[k] = at
        room -= size
        if parts[k] > 1:
            at, room = at + int(parts[k]) - 1, -1
    return start, parts


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists; nulls within a list become NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _usable(length: int) -> Column:
    return (F.size("embedding") == length) & (F.coalesce(norm(F.col("embedding")), F.lit(0.0)) > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """All rows with list and angle."""
    length = centres.shape[1] if len(centres) else 0
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    usable = F.coalesce(_usable(length), F.lit(False)) if len(centres) else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                near = unit(_matrix(part.column("embedding"))) @ shared.value.T
                own = near.argmax(1)
                angle = _angles(near[np.arange(len(part)), own])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(angle)], names=[*part.schema.names, "list", "angle"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    near = rows.filter(usable).mapInArrow(run, f"{fields}, list int, angle double")
    return near.unionByName(rows.filter(~usable).withColumns({"list": F.lit(OTHER), "angle": F.lit(None).cast("double")}))


def _write(spark: SparkSession, path: str, rows: DataFrame, centres: np.ndarray, rows_per_file: int = 100_000) -> None:
    staged = new_folder(spark, "index-rows")
    _assigned(rows, centres).write.parquet(staged)
    placed = spark.read.parquet(staged)
    bounds = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    bounds.coalesce(1).write.mode("append").parquet(f"{path}/bounds")
    files = max(1, -(-placed.count() // rows_per_file))
    keys = ["list", "angle", "id"]  # ranges cut a list with very many rows, even at one angle
    placed.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("append").option("parquet.block.size", 1 << 20).partitionBy("list").parquet(f"{path}/lists")
    remove_folder(spark, staged)


def build_index(chunks: DataFrame, path: str, lists: int | None = None, length: int | None = None, sample: int = SAMPLE, centre_bytes: int = CENTRE_BYTES) -> VectorIndex:
    """Indexes every row of ``chunks`` (id, embedding and any other columns) under a new folder.

    ``length`` is the vectors' length, by default that of most rows. There are ``lists``
    centres, by default the root of the number of rows, within ``centre_bytes``. No rows
    give an index without lists.
    """
    spark, path = chunks.sparkSession, path.rstrip("/")
    clash = {"list", "angle"} & set(chunks.columns)
    if clash:
        raise ValueError(f"rename {', '.join(sorted(clash))}: the index has columns of these names")
    if length is None:
        sizes = chunks.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = sizes["n"] if sizes else 0
    good = chunks.filter(_usable(length)) if length else chunks.limit(0)
    n = good.count()
    most = max(1, min(centre_bytes // (8 * max(1, length)), sample))
    lists = min(most, n, lists or max(1, math.isqrt(n)))
    picked = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").collect() if n else []
    vectors = unit(np.array([r["embedding"] for r in picked], np.float64)) if picked else np.zeros((0, length))
    centres = centres_of(vectors, lists) if picked else vectors
    told = [(k, c.tolist()) for k, c in enumerate(centres)]
    spark.createDataFrame(told, "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    chunks.limit(0).withColumns({"angle": F.lit(None).cast("double"), "list": F.lit(None).cast("int")}).coalesce(1).write.parquet(f"{path}/columns")
    _write(spark, path, chunks, centres)
    return VectorIndex(spark, path)
