"""Ranked lexical search by one scan of the documents, without an index of them.

All terms of the items form one Aho-Corasick automaton, broadcast to the tasks. A
document becomes its terms between single guards, the terms stand in the automaton
between guards too, and so each output is a whole term: its occurrences are counted
straight from the text. The scan leaves a document's length and its counts of item
terms; how many documents hold a term is added up from these. Then every document's
counts go through the items that hold the terms, a task keeps the best documents of
each item, and the best of all tasks are ranked.

Items are taken in blocks of a bounded number of terms, so that an automaton's size
has a bound: more items mean more scans, not a larger broadcast.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketlake.llm.common import text_slices, written

GUARD = 0x20
#: every byte of a term as it is, A-Z lower-cased; every other byte a guard
_TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else GUARD for c in range(256))
SPAN = 1 << 20  # bytes that are scanned at once
CELLS = 1 << 21  # documents times terms of items that are scored at once


def guarded(text: bytes) -> bytes:
    """The text with its terms in lower case and guards in place of all other bytes."""
    return text.translate(_TERM_BYTES)


def terms_of(text: bytes) -> list[bytes]:
    """The maximal runs of 0-9, A-Z, a-z and characters over U+007F, A-Z lower-cased."""
    return guarded(text).split()


def spans(text: bytes) -> Iterator[bytes]:
    """A guarded text in parts of about ``SPAN`` bytes, cut at guards; a longer term stays whole."""
    at = 0
    while len(text) - at > SPAN:
        end = text.rfind(b" ", at, at + SPAN)
        if end <= at:
            end = text.find(b" ", at + SPAN)
            if end < 0:
                break
        yield text[at:end]
        at = end
    yield text[at:]


class TermScanner:
    """Counts terms in texts by an automaton over the terms with their guards."""

    def __init__(self, terms: list[bytes]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            self.automaton.add_word(f" {term.decode('latin-1')} ", k)
        if terms:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, dict[int, int]]:
        """(terms of the text with repeats, occurrences of each of the automaton's terms)."""
        n, found = 0, Counter()
        for part in spans(guarded(text)):
            n += len(part.split())
            if len(self.automaton):
                found.update(map(itemgetter(1), self.automaton.iter(f" {part.decode('latin-1')} ")))
        return n, found


@lru_cache(maxsize=2)
def _scanner(key: str, terms) -> TermScanner:
    return TermScanner(terms.value)


class _Held:
    """A broadcast that a worker's memo knows by its key alone."""

    def __init__(self, key: str, cast):
        self.key, self.cast = key, cast

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other) -> bool:
        return self.key == other.key

    @property
    def value(self):
        return self.cast.value


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term) once for each term of an item; rows with one id count as one item.

    Items with a null id, and null, empty and termless texts, have none.
    """

    def run(batches):
        for batch in batches:
            keys, terms = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(terms_of(text or b""))
                keys += [key] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(terms, pa.binary())], names=["item_id", "term"])

    schema = f"item_id {items.schema[id_col].dataType.simpleString()}, term binary"
    rows = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema).distinct()


def term_counts(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms and counts (places in ``terms`` and occurrences) of each row.

    Null and termless texts have n 0; all rows come back, ids null or repeated too.
    """
    held = _Held(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(terms))

    def run(batches):
        scanner = _scanner(held.key, held)
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                found = [scanner.scan(t or b"") for t in texts]
                n = pa.array([x for x, _ in found], pa.int64())
                ends = np.cumsum([0, *(len(c) for _, c in found)], dtype=np.int32)
                each = [pa.array([v for _, c in found for v in of(c)], pa.int32()) for of in (dict.keys, dict.values)]
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in each]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), n, *lists], names=["doc_id", "n", "terms", "counts"])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n long, terms array<int>, counts array<int>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class ItemScores:
    """Scores of items for documents, from the documents' counts of the items' terms."""

    def __init__(self, weights: np.ndarray, first: np.ndarray, items: np.ndarray, n_items: int, n_docs: int, all_terms: int):
        #: the items of term t are items[first[t] : first[t + 1]]
        self.weights, self.first, self.items = weights, first, items
        self.n_items, self.n_docs, self.all_terms = n_items, n_docs, all_terms

    def scores(self, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Rows x items: the sum of the terms' parts, exact integers."""
        m = 10 + (90 * n * self.n_docs) // self.all_terms if self.all_terms else n + 10
        part = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        width = np.diff(self.first)[term]
        ends = np.cumsum(width)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - width - self.first[term], width)
        out = np.zeros(len(n) * self.n_items, np.int64)
        np.add.at(out, np.repeat(row * self.n_items, width) + self.items[at], np.repeat(part, width))
        return out.reshape(len(n), self.n_items)


class _Best:
    """The best documents of each item so far; a document under an item's bar is not held."""

    def __init__(self, n_items: int, k: int):
        self.k, self.bar = k, np.zeros(n_items, np.int64)  # scores must reach 1 at first
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        row, item = np.nonzero((scores >= self.bar) & (scores > 0))
        self.held.append((item, scores[row, item], ids[row]))
        self.size += len(item)
        if self.size > 4 * self.k * len(self.bar) + 1000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, ids = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(zip(*self.held)) or [[]] * 3))
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        begins = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.empty(0, np.int64)
        place = np.arange(len(item)) - np.repeat(begins, np.diff([*begins, len(item)]))
        last = place == self.k - 1
        self.bar[item[last]] = score[last]
        self.held, stay = [], place < self.k
        self.held.append((item[stay], score[stay], ids[stay]))
        self.size = int(stay.sum())
        return self.held[0]


def _block(docs: DataFrame, pairs: list[tuple[object, bytes]], item_type: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """The best documents of each task for the items of one block."""
    spark = docs.sparkSession
    names, terms = sorted({i for i, _ in pairs}), sorted({t for _, t in pairs})
    of_item, of_term = {x: n for n, x in enumerate(names)}, {x: n for n, x in enumerate(terms)}
    postings = sorted((of_term[t], of_item[i]) for i, t in pairs)
    first = np.searchsorted([t for t, _ in postings], np.arange(len(terms) + 1))
    counted = written(term_counts(docs, terms, id_col, text_col), "term-counts")
    whole = counted.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(terms), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    shared = spark.sparkContext.broadcast(ItemScores(term_weights(df, whole["docs"]), first, np.array([i for _, i in postings], np.int64), len(names), whole["docs"], whole["terms"]))

    def run(batches):
        score, best = shared.value, _Best(len(names), k)
        rows = max(1, CELLS // len(postings))
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                lists = part.column(2)
                lengths = np.diff(lists.offsets.to_numpy())
                best.add(
                    score.scores(part.column(1).to_numpy(), np.repeat(np.arange(len(part)), lengths), lists.flatten().to_numpy(), part.column(3).flatten().to_numpy().astype(np.int64)),
                    part.column(0).to_numpy(),
                )
        item, value, ids = best.cut()
        for at in range(0, len(item), 10_000):
            to = at + 10_000
            yield pa.RecordBatch.from_arrays([pa.array(item[at:to], pa.int32()), pa.array(ids[at:to], pa.int64()), pa.array(value[at:to], pa.int64())], names=["_item", "doc_id", "score"])

    found = counted.filter(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "_item int, doc_id long, score long")
    named = spark.createDataFrame(list(enumerate(names)), f"_item int, item_id {item_type}")
    return found.join(F.broadcast(named), "_item").select("item_id", "doc_id", "score")


def _blocks(pairs: DataFrame, most: int) -> int:
    """Into how many blocks items are dealt by hash, so that none but single items has over ``most`` terms."""
    n = 1
    while pairs.groupBy(_block_of(n)).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("a"), F.max("item_id").alias("b")).filter((F.col("n") > most) & (F.col("a") != F.col("b"))).limit(1).count():
        n *= 2
    return n


def _block_of(n: int) -> Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(n)).alias("block")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, terms_at_once: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` highest-scoring documents with a score above 0.

    A term's weight falls with the documents that hold it; its part of a score grows with
    its occurrences and falls with the document's terms; equal scores go by doc_id. Rows of
    ``docs`` with one id are documents of their own; those with a null id count in the
    statistics and are not ranked. Items without terms, or whose terms no document holds,
    have no rows. A block of items has at most ``terms_at_once`` terms with repeats (or is
    one item); each block is one scan.
    """
    spark = docs.sparkSession
    pairs = written(item_terms(items, item_id_col, item_text_col), "item-terms")
    blocks = _blocks(pairs, terms_at_once)
    out = spark.createDataFrame([], f"item_id {pairs.schema['item_id'].dataType.simpleString()}, doc_id long, score long")
    for block in range(blocks):
        rows = [(r["item_id"], bytes(r["term"])) for r in pairs.filter(_block_of(blocks) == block).collect()]
        if rows:
            out = out.unionByName(_block(docs, rows, pairs.schema["item_id"].dataType.simpleString(), k, id_col, text_col))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
