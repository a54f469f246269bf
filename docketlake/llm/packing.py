"""Shortest-pack-first packing of token sequences over their length histogram.

Documents become token ids and an end id, cut into pieces of at most the
sequence length. Only the histogram of piece lengths (at most ``length``
entries) reaches the driver. Lengths are placed longest first, each into the
pack that is shortest so far among those with room, and packs with one pattern
are counted together, so the plan's size depends on the sequence length alone.
The plan is then joined back to the pieces by length and rank.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from heapq import heapify, heappop, heappush
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketlake.llm.common import releasing, text_slices
from docketlake.llm.subwords import chunk_encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", memo: int = 800_000) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit).

    Null and empty texts give the end id alone. Every id lies in exactly one
    piece; all pieces of a document but its last have ``length`` ids. The
    document's id is carried as a long; other columns play no part.
    """
    if length < 1:
        raise ValueError("length must be positive")

    def cut(batches):
        encoder = chunk_encoder(tokenizer_path, memo)
        end, step = array("I", [end_id]).tobytes(), 4 * length
        for batch in batches:
            ids = batch.column(0)
            for at, texts in text_slices(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                for doc, data in zip(ids.slice(at, len(texts)).to_pylist(), encoder.encode(texts)):
                    data += end
                    for k in range(0, len(data), step):
                        piece = data[k : k + step]
                        for c, v in zip(out, (doc, k // 4, len(piece) // 4, len(data) // 4, piece)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(releasing(cut), PIECES)


Pattern = tuple[tuple[int, int], ...]  # runs of equal lengths: (length, how many)


def packing_plan(histogram: dict[int, int], length: int) -> list[tuple[Pattern, int]]:
    """(pattern, number of packs) pairs for a histogram of lengths."""
    open_packs: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by room left

    def longer(pattern: Pattern, size: int) -> Pattern:
        if pattern and pattern[-1][0] == size:
            return *pattern[:-1], (size, pattern[-1][1] + 1)
        return *pattern, (size, 1)

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        rooms = [-r for r in open_packs if r >= size]
        heapify(rooms)
        while rooms and left:  # the largest room first; a pack stays open under its new room
            room = -rooms[0]
            if not open_packs[room]:
                heappop(rooms)
                del open_packs[room]
                continue
            pattern, n = open_packs[room].pop()
            used = min(n, left)
            if n > used:
                open_packs[room].append((pattern, n - used))
            rest = room - size
            if rest >= size and rest not in open_packs:
                heappush(rooms, -rest)
            open_packs[rest].append((longer(pattern, size), used))
            left -= used
        while left:  # new packs, each filled with this length as far as the count goes
            each = length // size
            full, rest = divmod(left, each)
            n, k = (full, each) if full else (1, rest)
            open_packs[length - k * size].append((((size, k),), n))
            left -= n * k
    merged: dict[Pattern, int] = defaultdict(int)
    for packs in open_packs.values():
        for pattern, n in packs:
            merged[pattern] += n
    return [(p, n) for p, n in sorted(merged.items(), reverse=True) if n]


def plan_slots(plan: list[tuple[Pattern, int]], length: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, packs, run, first sequence, offset, padded length) of each run in the plan.

    A run has ``run`` pieces of its length in each of its packs, so it takes packs * run
    ranks: one after another within a pack, then on to the next pack. A sequence is
    padded to ``length``, but for one that is filled to a power of two.
    """
    base, ranks, slots = 0, defaultdict(int), []
    for pattern, n in plan:
        offset, fill = 0, sum(size * k for size, k in pattern)
        padded = length if fill & (fill - 1) else fill
        for size, k in pattern:
            slots.append((size, ranks[size], n, k, base, offset, padded))
            ranks[size] += n * k
            offset += size * k
        base += n
    return slots


def slot_chunks(slots: list[tuple]) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """((length, chunk, first rank, rank behind) of each chunk, the chunk of each slot).

    A length's runs in the order of their ranks are cut into about as many chunks as a
    chunk has runs, so a piece is tested against few chunks and then few runs.
    """
    by_size: dict[int, list[int]] = defaultdict(list)
    for n, slot in enumerate(slots):
        by_size[slot[0]].append(n)
    chunks, of = [], [0] * len(slots)
    for size, held in by_size.items():  # ranks grow with the order of the slots
        each = isqrt(len(held) - 1) + 1
        for c in range(0, len(held), each):
            some = held[c : c + each]
            last = slots[some[-1]]
            chunks.append((size, c // each, slots[some[0]][1], last[1] + last[2] * last[3]))
            for n in some:
                of[n] = c // each
    return chunks, of


def pack_pieces(pieces: DataFrame, length: int = 2048, rows_per_bucket: int = 50_000) -> DataFrame:
    """``pieces`` with sequence_id, offset and padded_length.

    ``pieces`` has doc_id, start and length (1 to ``length``) and is read more
    than once, so pass a written table. Ranks within a length come from sorting
    hash buckets of bounded size and summing the counts of the buckets before,
    so a frequent length meets no single task. Ties between equal rows are broken
    arbitrarily; each still gets a place of its own. No rows give no rows.
    """
    spark = pieces.sparkSession
    rows = pieces.count()
    buckets = max(1, -(-rows // rows_per_bucket)) * 8
    tagged = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = tagged.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(not 1 <= size <= length for size in histogram):
        raise ValueError(f"piece lengths must be 1 to {length}")
    slots = plan_slots(packing_plan(histogram, length), length)
    chunks, of = slot_chunks(slots)
    chunk_rows = spark.createDataFrame(chunks, "_length long, _chunk int, _from long, _to long")
    slot_rows = spark.createDataFrame([(*x, c) for x, c in zip(slots, of)], "_length long, _first long, _packs long, _run long, _base long, _offset long, _padded long, _chunk int")
    before = counts.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")) - 1
    ranked = tagged.withColumn("_local", local).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    rank, first, run = F.col("_rank"), F.col("_first"), F.col("_run")
    in_chunk = (F.col("_length") == F.col("length")) & (rank >= F.col("_from")) & (rank < F.col("_to"))
    near = ranked.join(F.broadcast(chunk_rows), in_chunk).select(*ranked.columns, F.col("_chunk").alias("_near"))
    in_run = (F.col("_length") == F.col("length")) & (F.col("_chunk") == F.col("_near")) & (rank >= first) & (rank < first + F.col("_packs") * run)
    placed = near.join(F.broadcast(slot_rows), in_run)
    nth = (rank - first) % run
    sequence = F.col("_base") + ((rank - first - nth) / run).cast("long")
    return placed.select(*pieces.columns, sequence.alias("sequence_id"), (F.col("_offset") + nth * F.col("length")).alias("offset"), F.col("_padded").alias("padded_length"))
