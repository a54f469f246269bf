"""Similarity retrieval and what is rendered from it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketlake.functions.text import percent
from docketlake.functions.vector import cosine, norm

SLACK = 1e-9  # similarities; far above the rounding of a product of matrices
MATCH_THRESHOLD, MATCH_COUNT, PRECEDENT_LIMIT = 0.5, 5, 5

#: Fixed texts of the rendered context.
RULE = "\n\n---\n\n"
NO_SOURCES = "No relevant documents found in the knowledge base."


def scope(chunks: DataFrame, matter_id=None, document_type_id=None, precedent_only: bool = False, matter_or_precedent: bool = False) -> DataFrame:
    """The optional filters, as plain conjuncts that reach the scan.

    A matter filter leaves precedent rows out, as they have no matter;
    ``matter_or_precedent`` lets them in beside the matter's own.
    """
    if matter_id is not None:
        own = F.col("matter_id") == matter_id
        chunks = chunks.filter(own | F.col("is_precedent") if matter_or_precedent else own)
    if document_type_id is not None:
        chunks = chunks.filter(F.col("document_type_id") == document_type_id)
    return chunks.filter("is_precedent") if precedent_only else chunks


def _checked(threshold: float, count: int) -> None:
    if count < 1:
        raise ValueError("match_count must be positive")
    if threshold != threshold:
        raise ValueError("match_threshold must be a number")


def match_documents(chunks: DataFrame, query: Sequence[float], match_threshold: float = MATCH_THRESHOLD, match_count: int = MATCH_COUNT, filter_matter_id=None, filter_document_type_id=None, precedent_only: bool = False) -> DataFrame:
    """The ``match_count`` chunks most similar to a query vector, above a threshold.

    Similarity must exceed the threshold; chunks whose vector is null, zero or of
    another length have none. Ties go to the smaller id. One pass, a top-k in each
    task and one merge: no full sort.
    """
    _checked(match_threshold, match_count)
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(float(x) ** 2 for x in query) ** 0.5
    kept = scope(chunks, filter_matter_id, filter_document_type_id, precedent_only)
    scored = kept.withColumn("similarity", cosine(F.col("embedding"), q, norm_b=F.lit(size))).filter(F.col("similarity") > match_threshold)
    names = [c for c in ("id", "content", "metadata", "matter_id", "document_type_id") if c in chunks.columns]
    return scored.orderBy(F.desc("similarity"), "id").limit(match_count).select(*names, "similarity")


def nearest_ids(rows: DataFrame, count: int) -> DataFrame:
    """Of rows (id, embedding) with one and the same vector, those with the ``count`` smallest ids.

    They tie for every query and ties go to the smaller id, so no other row can be among
    the first ``count`` matches.
    """
    n = F.row_number().over(Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("id"))
    return rows.withColumn("_n", n).filter(F.col("_n") <= count).drop("_n")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists; nulls within a list become NaN."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def block_matches(chunks: DataFrame, queries: DataFrame, keys: Sequence[str], threshold: float, count: int) -> DataFrame:
    """query_id, id, similarity: the best ``count`` matches above a threshold in each block.

    ``chunks`` (id, embedding, norm) and ``queries`` (query_id, q, q_norm) meet where
    ``keys`` are equal, and one block of each is in memory. A product of matrices names
    the pairs that can be among the best; their similarities are then summed in the order
    of ``cosine``, so they are the same numbers.
    """

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sizes_c, sizes_q = (t.column(k).combine_chunks().value_lengths().to_numpy(zero_copy_only=False) for t, k in ((c, "embedding"), (q, "q")))
        for size in np.intersect1d(sizes_c[sizes_c > 0], sizes_q[sizes_q > 0]):
            cs, qs = np.flatnonzero(sizes_c == size), np.flatnonzero(sizes_q == size)
            cs = cs[pc.sort_indices(c.column("id").take(pa.array(cs)), null_placement="at_start").to_numpy()]  # ties in order of ids
            held, norms = _vectors(c.column("embedding").take(pa.array(cs))), c.column("norm").to_numpy(zero_copy_only=False)[cs]
            for at in range(0, len(qs), step := max(1, (4 << 20) // max(1, len(cs)))):
                part = qs[at : at + step]
                asked, q_norms = _vectors(q.column("q").take(pa.array(part))), q.column("q_norm").to_numpy(zero_copy_only=False)[part]
                with np.errstate(all="ignore"):
                    near = (asked @ held.T) / (q_norms[:, None] * norms)
                    near[~np.isfinite(near)] = -np.inf
                    least = np.partition(near, -count, axis=1)[:, -count] if len(cs) > count else np.full(len(part), -np.inf)
                    # the lowest of the best may be off by the rounding, and so may the others
                    row, col = np.nonzero((near >= np.maximum(least, threshold)[:, None] - SLACK) & (near > -np.inf))
                    for a in range(0, len(row), 1 << 16):
                        x, y = row[a : a + (1 << 16)], col[a : a + (1 << 16)]
                        total = np.zeros(len(x))
                        for k in range(size):
                            total += held[y, k] * asked[x, k]
                        total /= norms[y] * q_norms[x]
                        good = total > threshold
                        out.append((part[x[good]], cs[y[good]], total[good]))
        row, col, score = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        order = np.lexsort((-score, row))  # stable: equal scores stay in order of ids
        row, col, score = row[order], col[order], score[order]
        first = np.maximum.accumulate(np.where(np.diff(row, prepend=-1) != 0, np.arange(len(row)), 0))
        best = np.arange(len(row)) - first < count
        return pa.table([q.column("query_id").take(pa.array(row[best])), c.column("id").take(pa.array(col[best])), pa.array(score[best])], names=["query_id", "id", "similarity"])

    kinds = queries.schema["query_id"].dataType.simpleString(), chunks.schema["id"].dataType.simpleString()
    return chunks.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")


def ranked(scored: DataFrame, threshold: float, count: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return scored.filter(F.col("similarity") > threshold).withColumn("rank", rank).filter(F.col("rank") <= count)


def match_documents_batch(chunks: DataFrame, queries: DataFrame, match_threshold: float = MATCH_THRESHOLD, match_count: int = MATCH_COUNT, slices: int | None = None, rows_per_slice: int = 4_000, rows_per_bucket: int = 20_000) -> DataFrame:
    """Top matches of many query rows (query_id, embedding): query_id, id, similarity, rank.

    Every chunk meets every query, in blocks of two sides: queries are dealt to slices of
    about ``rows_per_slice``, chunks to buckets of about ``rows_per_bucket``, and a task
    multiplies one slice with one bucket. So both the tasks and the copies sent grow with
    the data, and none takes a whole table. Each block keeps a query's best matches only.
    Ties go to the smaller id. Norms are computed once a row; copies of a vector beyond
    the ``match_count`` smallest ids can't match and are left out first.
    """
    _checked(match_threshold, match_count)
    if slices is None:
        slices = max(1, -(-queries.count() // rows_per_slice))
    buckets = max(8, -(-chunks.count() // rows_per_bucket))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select("query_id", F.col("embedding").alias("q"), norm(F.col("embedding")).alias("q_norm")).filter("q_norm > 0")
    q = q.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)).cast("long")).withColumn("bucket", every(buckets))
    c = nearest_ids(chunks.select("id", "embedding"), match_count).withColumn("norm", norm(F.col("embedding"))).filter("norm > 0")
    c = c.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("long")).withColumn("slice", every(slices))
    return ranked(block_matches(c, q, ["slice", "bucket"], match_threshold, match_count), match_threshold, match_count)


def newest_first(rows: DataFrame, count: int, *ties: str, by: str = "created_at") -> DataFrame:
    return rows.orderBy(F.desc(by), *ties).limit(count)


def recent_precedents(chunks: DataFrame, document_type_id, count: int = PRECEDENT_LIMIT, ties: Sequence[str] = ("storage_path", "chunk_index")) -> DataFrame:
    """The newest precedent chunks of a type (chunks, not documents)."""
    return newest_first(chunks.filter((F.col("document_type_id") == document_type_id) & F.col("is_precedent")), count, *ties)


def ordered_join(order: Sequence[Column], render, value: Column, separator: str) -> Column:
    """Aggregate: values in order, each rendered with its number from 1, joined.

    Gathers a group, so the group must be bounded: top-k matches, a document's
    parties, one thread.
    """
    held = F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], value.alias("v"))))
    return F.array_join(F.transform(held, lambda x, i: render(x["v"], (i + 1).cast("string"))), separator)


def render_sources(matches: DataFrame) -> DataFrame:
    """One row: the matches as numbered sources with their similarity, or a fixed sentence."""
    value = F.struct("similarity", "content")
    shown = lambda v, n: F.concat(F.lit("[Source "), n, F.lit("] (Similarity: "), percent(v["similarity"], 1), F.lit(")\n"), v["content"])
    text = ordered_join([-F.col("similarity"), F.col("id")], shown, value, RULE)
    return matches.agg(F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_SOURCES)).alias("context"), F.count(F.lit(1)).alias("n_sources"))


def snippet(content: Column, similarity: Column, length: int = 100) -> Column:
    return F.concat(percent(similarity, 0), F.lit(" match — "), F.substring(content, 1, length), F.lit("…"))


def speaker(role: Column) -> Column:
    return F.when(role == "user", "Lawyer").otherwise("Assistant")


def transcripts(messages: DataFrame, thread: str = "thread_id", order: str = "created_at") -> DataFrame:
    """thread, transcript, n_turns: each thread's turns in order, by speaker."""
    line = lambda v, n: F.concat(speaker(v["role"]), F.lit(": "), v["content"])
    return messages.groupBy(thread).agg(ordered_join([F.col(order)], line, F.struct("role", "content"), "\n").alias("transcript"), F.count(F.lit(1)).alias("n_turns"))


def with_new_turn(history: Column, content: str) -> Column:
    """A history of (role, content) with the user's new turn behind it."""
    return F.concat(history, F.array(F.struct(F.lit("user").alias("role"), F.lit(content).alias("content"))))


def seeded(history: Column, seed: str) -> Column:
    """An empty history starts with a fixed first user turn."""
    return F.when(F.size(history) > 0, history).otherwise(F.array(F.struct(F.lit("user").alias("role"), F.lit(seed).alias("content"))))


def section(title: str, body: Column) -> Column:
    """A titled section, or nothing where its body is null or empty."""
    return F.coalesce(F.concat(F.lit(f"\n\n{title}\n"), F.nullif(body, F.lit(""))), F.lit(""))


def draft_context(matters: DataFrame, clients: DataFrame, parties: DataFrame, precedents: DataFrame, transcripts_: DataFrame | None = None) -> DataFrame:
    """id, context of each matter: names, description, parties, precedents, interview.

    ``parties`` (matter_id, name, role; in the order of ``ord`` where they have it, else
    of their names), ``precedents`` (matter_id, ord, content) and ``transcripts_``
    (matter_id, transcript) are bounded a matter. Sections without content are left out.
    """
    order = [F.col(c) for c in ("ord", "name", "role") if c in parties.columns]
    p = parties.groupBy("matter_id").agg(ordered_join(order, lambda v, n: F.concat(F.lit("- "), v["name"], F.lit(" ("), v["role"], F.lit(")")), F.struct("name", "role"), "\n").alias("parties"))
    r = precedents.groupBy("matter_id").agg(ordered_join([F.col("ord")], lambda v, n: F.concat(F.lit("[Precedent "), n, F.lit("]\n"), v), F.col("content"), RULE).alias("precedents"))
    out = matters.join(clients.select(F.col("id").alias("client_id"), F.col("name").alias("client_name")), "client_id", "left")
    out = out.join(p.withColumnRenamed("matter_id", "id"), "id", "left").join(r.withColumnRenamed("matter_id", "id"), "id", "left")
    talk = F.lit("")
    if transcripts_ is not None:
        out = out.join(transcripts_.withColumnRenamed("matter_id", "id"), "id", "left")
        talk = section("INTAKE INTERVIEW:", F.col("transcript"))
    about = lambda label, c: F.coalesce(F.concat(F.lit(label), F.nullif(c, F.lit(""))), F.lit(""))
    head = F.concat(F.lit("Matter: "), F.col("name"), F.coalesce(F.concat(F.lit(" (client: "), F.nullif("client_name", F.lit("")), F.lit(")")), F.lit("")), about(", sector: ", F.col("sector")))
    text = F.concat(head, section("Description:", F.col("description")), section("KNOWN PARTIES:", F.col("parties")), section("PRECEDENT:", F.col("precedents")), talk)
    return out.select("id", text.alias("context"))
