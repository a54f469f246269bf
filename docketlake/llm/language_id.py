"""Language of words and texts by a linear-chain conditional random field.

Each word gets a score for each language from its affixes, character n-grams, its own
identity (hashed into a fixed table) and the lexicons of the languages; transitions
between neighbouring words are learned, and forward-backward over the whole text gives
every word's posterior. So a text that switches language is labelled word by word; the
text's language is the one with the largest mean posterior.

The sample is bounded by ``train_docs`` rows a language and read whole: every second
text fills the lexicons, the words of the others, joined in stretches of different
languages so that transitions see switches, fit the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.llm.common import text_slices
from docketlake.llm.shingles import mixed

BUCKETS = 1 << 15
LONGEST = 32  # letters in a word of the chain
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_PLACE = mixed(np.arange(1, LONGEST + 3, dtype=np.uint64), 5) | np.uint64(1)


def words_of(text: str) -> list[str]:
    """The runs of letters of a text with their marks, lower-cased.

    A run of over ``LONGEST`` characters becomes pieces of that many, each with the last
    two of the one before, so every letter and 3-gram counts and the language
    can switch within a run.
    """
    words = _WORD.findall(text.lower())
    if all([len(w) <= LONGEST for w in words]):
        return words
    return [w[k : k + LONGEST] for w in words for k in range(0, max(1, len(w) - 2), LONGEST - 2)]


class Words:
    """Features of some words, all at once: hashes of affixes, n-grams and the words."""

    def __init__(self, words: list[str]):
        self.n = len(words)
        lens = np.fromiter(map(len, words), np.int64, self.n)
        x = mixed(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), 9)
        first = np.cumsum(lens) - lens
        owner = np.repeat(np.arange(self.n), lens)
        place = np.arange(len(x)) - first[owner]
        self.hash = mixed(np.add.reduceat(x * _PLACE[place], first), 1)
        flat, own = [self.hash], [np.arange(self.n)]

        def add(h: np.ndarray, at: np.ndarray, kind: int):
            flat.append(mixed(h, kind))
            own.append(at)

        # n-grams with the word's borders, which are zeros
        y = np.zeros(len(x) + 2 * self.n, np.uint64)
        y[np.arange(len(x)) + 2 * owner + 1] = x
        held = np.repeat(np.arange(self.n), lens + 2)
        a, b = _PLACE[0], _PLACE[1]
        two = y[:-1] * a + y[1:]
        same = held[:-1] == held[1:]
        add(two[same], held[:-1][same], 2)
        same = held[:-2] == held[2:]
        add((y[:-2] * b + two[1:])[same], held[:-2][same], 3)
        every = np.arange(self.n)
        for back in (False, True):
            h = np.zeros(self.n, np.uint64)
            for k in range(3):  # a word shorter than the affix gives its whole self again
                there = lens > k
                at = np.where(there, first + lens - 1 - k if back else first + k, 0)
                h = np.where(there, h * a + x[at], h)
                add(h, every, 10 + 3 * back + k)
        self.flat, self.owner = (np.concatenate(flat) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(own)


def forward_backward(emit: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Posteriors of many sequences at once, with the forward vectors and local scores.

    ``emit`` holds the sequences one after another (words x labels); ``lens`` falls.
    Behind its first word a sequence is cut into segments of about the square root of
    the longest one's length. All segments' products of transition matrices come first,
    then each sequence's vectors at its borders, then the words of all segments: exact,
    and the steps grow with the square root of the longest text.
    """
    k = emit.shape[1]
    e = np.exp(emit - emit.max(1, keepdims=True)).astype(np.float64)
    a = np.exp(trans - trans.max()).astype(np.float64)
    first = np.cumsum(lens) - lens
    alpha, post = np.empty_like(e), np.empty_like(e)
    head = np.exp(start - start.max()) * e[first]
    alpha[first] = head = head / head.sum(1, keepdims=True)
    size = max(8, int(np.sqrt(lens[0]))) if len(lens) else 8
    n_segs = -(-(lens - 1) // size)
    seq = np.repeat(np.arange(len(lens)), n_segs)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(n_segs) - n_segs, n_segs)
    begin, length = first[seq] + 1 + nth * size, np.minimum(size, lens[seq] - 1 - nth * size)
    order = np.argsort(-length, kind="stable")
    begin, length, rank = begin[order], length[order], np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    active = np.searchsorted(-length, -np.arange(size), side="left")  # segments longer than s
    through = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for s, n in enumerate(active):
        m = (through[:n] @ a) * e[begin[:n] + s][:, None, :]
        through[:n] = m / m.max((1, 2), keepdims=True)
    into, out = np.empty((len(order), k)), np.empty((len(order), k))
    base = np.cumsum(n_segs) - n_segs
    for j in range(int(n_segs.max(initial=0))):
        rows = np.flatnonzero(n_segs > j)
        at = rank[base[rows] + j]
        into[at] = head[rows]
        v = (head[rows][:, None, :] @ through[at])[:, 0]
        head[rows] = v / v.sum(1, keepdims=True)
    tail = np.ones((len(lens), k))
    for j in range(int(n_segs.max(initial=0)) - 1, -1, -1):
        rows = np.flatnonzero(n_segs > j)
        at = rank[base[rows] + j]
        out[at] = tail[rows]
        v = (through[at] @ tail[rows][:, :, None])[:, :, 0]
        tail[rows] = v / v.max(1, keepdims=True)
    post[first] = alpha[first] * tail
    for s, n in enumerate(active):
        v = (into[:n] @ a) * e[begin[:n] + s]
        alpha[begin[:n] + s] = into[:n] = v / v.sum(1, keepdims=True)
    for s in range(size - 1, -1, -1):
        n = active[s]
        rows = begin[:n] + s
        post[rows] = alpha[rows] * out[:n]
        v = (e[rows] * out[:n]) @ a.T
        out[:n] = v / v.max(1, keepdims=True)
    post /= post.sum(1, keepdims=True)
    return post, alpha, e


class LanguageField:
    """Languages, their lexicons, feature table (languages x features), transitions, start scores."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs = langs
        self.table = np.zeros((k, BUCKETS + k), np.float32)
        self.trans, self.start = np.zeros((k, k), np.float32), np.zeros(k, np.float32)
        self.lexicons: list[np.ndarray] = [np.empty(0, np.uint64)] * k

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature, word) of every feature that holds."""
        w = Words(words)
        flat, own = [w.flat], [w.owner]
        for c, lexicon in enumerate(self.lexicons):
            if len(lexicon):
                at = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, w.hash), len(lexicon) - 1)] == w.hash)
                flat.append(np.full(len(at), BUCKETS + c))
                own.append(at)
        return np.concatenate(flat), np.concatenate(own)

    def scores(self, flat: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(own, row[flat], n) for row in self.table], axis=1)

    def fit(self, texts: dict[str, list[str]], epochs: int = 2, seed: int = 3, least: int = 2) -> LanguageField:
        """Lexicons from every second text, AdaGrad on the conditional likelihood of the others.

        A lexicon holds the words that occur ``least`` times or more. All words of the
        other texts take part, in stretches of 4 to 30 that are shuffled and joined by
        threes at most.
        """
        if len(self.langs) < 2:
            return self
        r = np.random.default_rng(seed)
        stretches: list[tuple[list[str], int]] = []
        for y, lang in enumerate(self.langs):
            held = [w for w in map(words_of, texts[lang]) if w]
            if seen := [w for words in held[1::2] for w in words]:
                h, n = np.unique(Words(seen).hash, return_counts=True)
                self.lexicons[y] = h[n >= least]
            for words in held[::2]:
                at = 0
                while at < len(words):
                    size = int(r.integers(4, 31))
                    stretches.append((words[at : at + size], y))
                    at += size
        sums = [np.full_like(x, 1e-3) for x in (self.table, self.trans, self.start)]
        for _ in range(epochs):
            order, made, at = r.permutation(len(stretches)), [], 0
            while at < len(order):
                size = int(r.integers(1, 4))
                part = [stretches[i] for i in order[at : at + size]]
                made.append(([w for words, _ in part for w in words], [y for words, y in part for _ in words]))
                at += size
            for k in range(0, len(made), 50):
                self._step(sorted(made[k : k + 50], key=lambda x: -len(x[0])), sums, 0.3)
        return self

    def _step(self, batch, sums, rate: float) -> None:
        flat, own = self.features([w for words, _ in batch for w in words])
        labels = np.array([y for _, lab in batch for y in lab])
        lens = np.array([len(words) for words, _ in batch])
        post, alpha, e = forward_backward(self.scores(flat, own, len(labels)), lens, self.trans, self.start)
        d = -post
        d[np.arange(len(labels)), labels] += 1
        first = np.cumsum(lens) - lens
        inner = np.ones(len(labels), bool)
        inner[first] = False
        t = np.nonzero(inner)[0]
        a = np.exp(self.trans)
        # pair posteriors: alpha(t-1) a e(t) beta(t), with beta taken from post / alpha
        pair = alpha[t - 1][:, :, None] * a[None] * (e[t] * post[t] / np.maximum(alpha[t], 1e-30))[:, None, :]
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-30)
        g = [np.stack([np.bincount(flat, x[own], self.table.shape[1]) for x in d.T]), -pair.sum(0), d[first].sum(0)]
        np.add.at(g[1], (labels[t - 1], labels[t]), 1)
        for x, gx, s in zip((self.table, self.trans, self.start), g, sums):
            s += gx * gx
            x += rate * gx / np.sqrt(s)


class Labeller:
    """Applies a field to texts, with a bounded memo of words' scores."""

    def __init__(self, field: LanguageField, memo: int = 200_000):
        self.field, self.memo = field, memo
        self.at: dict[str, int] = {}
        self.scores = np.empty((1024, len(field.langs)), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        at = self.at
        fresh = [w for w in dict.fromkeys(words) if w not in at]
        if fresh:
            n = len(at)
            while len(self.scores) < n + len(fresh):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            for k in range(0, len(fresh), 20_000):
                some = fresh[k : k + 20_000]
                self.scores[n + k : n + k + len(some)] = self.field.scores(*self.field.features(some), len(some))
            at.update(zip(fresh, range(n, n + len(fresh))))
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def posteriors(self, texts: list[str]) -> list[np.ndarray]:
        """Posteriors of the words of each text, words x languages."""
        k = len(self.field.langs)
        words = [words_of(x) for x in texts]
        if len(self.at) > self.memo:
            self.at, self.scores = {}, np.empty((1024, k), np.float32)
        order = sorted(range(len(texts)), key=lambda i: -len(words[i]))
        order = [i for i in order if words[i]]
        out = [np.empty((0, k), np.float32)] * len(texts)
        if not order:
            return out
        lens = np.array([len(words[i]) for i in order])
        rows = self._rows([w for i in order for w in words[i]])
        emit = self.scores[rows]
        post = forward_backward(emit, lens, self.field.trans, self.field.start)[0]
        for i, part in zip(order, np.split(post, np.cumsum(lens)[:-1])):
            out[i] = part
        return out


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 200) -> LanguageField | None:
    """A field over the non-null languages of ``docs``; None where there are none.

    Fitted on at most ``train_docs`` rows a language, those with the smallest hash
    of id and text.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    near = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= train_docs).select("lang", "h")
    cut = near.groupBy("lang").agg(F.max("h").alias("cut"))
    texts: dict[str, list[str]] = {}
    for r in rows.join(F.broadcast(cut), "lang").filter("h <= cut").dropDuplicates(["lang", "h"]).orderBy("lang", "h", "text").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return LanguageField(sorted(texts)).fit(texts) if texts else None


def identify_language(docs: DataFrame, field: LanguageField | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, shares (map of language to mean posterior).

    A text that is null or has no letter is ``und`` with score 0, as is every text
    without a field. Texts are read whole; rows stay as many as they are.
    """

    def run(batches):
        labeller = Labeller(field) if field else None
        kind = pa.map_(pa.string(), pa.float64())
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                lang, score, shares = [], [], []
                for p in labeller.posteriors(texts) if labeller else [()] * len(texts):
                    mean = p.mean(0).astype(float) if len(p) else None
                    k = int(mean.argmax()) if len(p) else -1
                    lang.append(field.langs[k] if len(p) else "und")
                    score.append(min(1.0, float(mean[k])) if len(p) else 0.0)
                    shares.append(list(zip(field.langs, mean.tolist())) if len(p) else [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, kind)], names=[id_col, "lang_pred", "score", "shares"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, shares map<string, double>"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def label_words(docs: DataFrame, field: LanguageField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word or piece (see ``words_of``): id, n (from 0), word, lang, score."""

    def run(batches):
        labeller = Labeller(field)
        for batch in batches:
            ids = batch.column(0)
            for at, texts in text_slices(batch, "text", chars=200_000):
                for i, (x, p) in enumerate(zip(texts, labeller.posteriors(texts))):
                    if len(p):
                        best = p.argmax(1)
                        yield pa.RecordBatch.from_arrays([pa.array([ids[at + i].as_py()] * len(p), ids.type), pa.array(range(len(p)), pa.int64()), pa.array(words_of(x), pa.string()), pa.array([field.langs[k] for k in best], pa.string()), pa.array(p[np.arange(len(p)), best].astype(float), pa.float64())], names=[id_col, "n", "word", "lang", "score"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n long, word string, lang string, score double"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
