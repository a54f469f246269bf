"""Runs of words that repeat with a period, by an online sparse diagonal program.

Word i lies on the diagonal of lag d when it equals word i - d. A diagonal's match
length grows by one with each next word that lies on it; when a word does not, the
diagonal ends, and if it is long enough its run is given out at once.

Only earlier occurrences that can belong to a run take part. A run of smallest period
q spans at least three periods, so a window of K >= q words inside it (K a power of
two, K < 2q) has its nearest earlier occurrence exactly q before, and a nearest
occurrence q before that goes on for long enough is such a run. So at each place only
the nearest earlier occurrence of the window of each size K counts, and only if it
lies more than K/2 and at most K words back. That leaves at most one lag a place and
size, places whose window of half the size did not recur are out for good, and the
work is the words times the logarithm of the longest period, whatever the text.
Runs are compared word by word with what lies a period before, so hashes decide nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import text_slices
from docketlake.llm.shingles import mixed

FIRST = 8  # words in the smallest window; it serves all periods up to itself
SHORTEST, PERIODS = 24, 3  # a run has that many words and that many periods
SPAN = 1 << 22  # bytes of text that are cut into words at once

Run = tuple[int, int, int]
_ONE = np.uint64(1)


def numbered(words: list[bytes], known: dict[bytes, int]) -> list[int]:
    """A number for each word, equal for equal words; long words are known by digest."""
    put = known.setdefault
    return [put(w if len(w) <= 64 else b" " + blake2b(w, digest_size=32).digest(), len(known)) for w in words]


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than space and U+0009 to U+000D, which is where bytes split."""
    return text.split()


def word_ids(text: bytes) -> np.ndarray:
    """Numbers of the words of a text of any length, a stretch at a time."""
    known: dict[bytes, int] = {}
    return np.concatenate([np.array(numbered(words_of(text[a:b]), known), np.int64) for a, b in _stretches(text)])


def _stretches(text: bytes) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches of about ``SPAN`` bytes that end at white space."""
    at = 0
    while len(text) - at > SPAN:
        end = 1 + max(text.rfind(c, at, at + SPAN) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if not end:
            break
        yield at, end
        at = end
    yield at, len(text)


def _earlier(ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, places, lags) for each window size, places ascending.

    ``ids`` holds the words of several texts, text t from ``bounds[t]`` to before
    ``bounds[t + 1]``; no window crosses from one text to the next.
    """
    longest = int(np.diff(bounds).max(initial=0))
    if longest < SHORTEST:
        return
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = bounds[text + 1] - np.arange(len(ids))  # words from a place to its text's end
    h = mixed(ids.astype(np.uint64) + _ONE)
    at, size = np.arange(len(ids)), 1
    while size < FIRST:  # all windows of two, four and eight words
        at = at[left[at] >= 2 * size]
        h[at] = mixed(h[at] + mixed(h[at + size], seed=size))
        size *= 2
    h[at] ^= mixed(text[at].astype(np.uint64), seed=99)  # windows of other texts are other windows
    again = np.zeros(len(ids), bool)
    while len(at):
        order = at[np.argsort(h[at], kind="stable")]
        same = h[order[1:]] == h[order[:-1]]
        places, lags = order[1:][same], np.diff(order)[same]
        near = (lags <= size) & ((lags > size // 2) | (size == FIRST))
        places, lags = places[near], lags[near]
        by = np.argsort(places)
        yield size, places[by], lags[by]
        if PERIODS * size >= longest:  # longer periods do not fit three times
            return
        again[:] = False
        again[order[1:][same]] = again[order[:-1][same]] = True
        at = np.flatnonzero(again)
        at = at[left[at] >= 2 * size]
        at = at[again[at + size]]
        h[at] = mixed(h[at] + mixed(h[at + size], seed=size))
        size *= 2


def diagonal_runs(ids: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    out: list[list[Run]] = [[] for _ in range(len(bounds) - 1)]

    def end(lag: int, first: int, last: int, size: int) -> None:
        start, stop = first - lag, last + size
        if stop - start >= max(SHORTEST, PERIODS * lag) and np.array_equal(ids[start : stop - lag], ids[start + lag : stop]):
            t = int(np.searchsorted(bounds, start, "right")) - 1
            out[t].append((start - int(bounds[t]), stop - start, lag))

    for size, places, lags in _earlier(ids, bounds):
        lag, first, last = 0, -1, -2  # the size's active diagonal: a place has one lag of this size
        for a in range(0, len(places), 1 << 16):
            for i, d in zip(places[a : a + (1 << 16)].tolist(), lags[a : a + (1 << 16)].tolist()):
                if d == lag and i == last + 1:
                    last = i
                    continue
                if lag:
                    end(lag, first, last, size)
                lag, first, last = d, i, i
        if lag:
            end(lag, first, last, size)
    for runs in out:
        runs.sort()
    return out


def collapsed(n: int, runs: list[Run]) -> np.ndarray | None:
    """Which of ``n`` words stay when each run keeps its first period; None: all."""
    if not runs:
        return None
    stay = np.ones(n, bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


def repeated_tail(doc_id, n: int) -> np.ndarray | None:
    """Places of the words of a document with a planted tail; None: words as they are.

    One id in ten has the words from some place on repeated; a null id has none.
    """
    if doc_id is None or not n:
        return None
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _kept_text(text: bytes, order: np.ndarray | None, stay: np.ndarray | None) -> bytes:
    """The words in ``order`` that stay, joined by one space."""
    if order is None:
        parts, at = [], 0
        for a, b in _stretches(text):
            words = words_of(text[a:b])
            if stay is not None:
                there = stay[at : at + len(words)].tolist()
                at += len(words)
                words = [w for w, s in zip(words, there) if s]
            if words:
                parts.append(b" ".join(words))
        return b" ".join(parts)
    words = words_of(text)
    return b" ".join([words[k] for k in (order if stay is None else order[stay]).tolist()])


def periodic_runs(docs: DataFrame, order: Callable[[object, int], np.ndarray | None] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs array<struct<start, length, period>> and collapsed text of each row.

    Starts and lengths count words from 0. ``collapsed`` is the text with only the
    first period of each run left, words joined by one space. ``order(id, n)`` may
    give places of the words to be read instead of the n words as they stand. Null
    and empty texts, and those of white space, have no runs and an empty collapsed
    text. Rows keep their number; ids may be null or repeated; texts are read whole.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                keys = batch.column(0).slice(at, len(texts))
                ids, orders = [], []
                for key, text in zip(keys.to_pylist(), texts):
                    x = word_ids(text or b"")
                    o = order(key, len(x)) if order else None
                    orders.append(o)
                    ids.append(x if o is None else x[o])
                bounds = np.cumsum([0, *map(len, ids)])
                found = diagonal_runs(np.concatenate(ids), bounds)
                kept = [_kept_text(t or b"", o, collapsed(len(x), r)) for t, o, x, r in zip(texts, orders, ids, found)]
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found], kind)
                yield pa.RecordBatch.from_arrays([keys, runs, pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "runs", "collapsed"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of runs, the run of most periods and digests of the runs and of the collapsed text.

    More periods: the greater exact quotient of length and period; of equal ones the
    smallest start, then the smallest period. Without a run the four are null.
    """
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda kept, x: F.when(more(x, kept), x).otherwise(kept))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    top = found.withColumn("_best", best)
    milli = F.expr("1000 * _best.length div _best.period")
    return top.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        milli.alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
