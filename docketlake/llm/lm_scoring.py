"""Language-model scores: a causal self-attention model over subword ids.

The model reads overlapping windows of subword ids and scores each id once. The
probability of an id is that of its class given the window, by one causal attention
layer with learned relative positions, times that of the id within its class after
the class before it. Since there is one layer, queries, keys, values and the direct
path depend on the id alone and are looked up.

All of it is gathered from every training text, so it grows with the corpus: counts of
the ids beside each id give the classes and the first embeddings, every window of every
text fits the weights in numpy, and counts of all ids after each class give the shares
within classes. Tasks train on their windows from common weights; after
each round the weights are averaged, those of an id over the tasks that met it.

Beside it stands a unigram score over whole words, counted over all training texts.
Words travel as 64-bit hashes. Words over a fixed share of the tokens are few (at
most one over that share) and looked up by every task; all rarer words are dealt by
hash to the tasks that hold their counts.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import releasing, text_slices, written
from docketlake.llm.shingles import distinct_hashes, mixed
from docketlake.llm.subwords import chunk_encoder

WINDOW, STRIDE, WIDTH, KEY, CLASSES = 32, 28, 16, 8, 48
LOG10 = math.log(10)
SLICE = 512  # ids whose embeddings travel together
_ONES = np.ones(CLASSES, np.float32)


def _exp(x: np.ndarray, there: np.ndarray | None = None) -> None:
    """exp of ``x`` in its place, up to a factor a row (of the last axis), which keeps it in range.

    Places that are not ``there`` become 0.
    """
    if x.max() > 60 or x.min() < -60:
        if there is not None:
            np.copyto(x, np.float32(-1e9), where=~there)
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    if there is not None:
        x *= there


_PLACES = np.arange(WINDOW)
_BACK = _PLACES[:, None] - _PLACES[None, :]
_AFTER, _BACK = _BACK < 0, np.maximum(_BACK, 0)
_ROOM: dict[str, np.ndarray] = {}


def _room(name: str, *shape: int) -> np.ndarray:
    """An array of this shape with any content. Those of a name share their memory, which stays
    with the worker, as mapping it anew for each block costs time."""
    size = math.prod(shape)
    if name not in _ROOM or _ROOM[name].size < size:
        _ROOM[name] = np.empty(size, np.float32)
    return _ROOM[name][:size].reshape(shape)


def _exp_back(s: np.ndarray, rel: np.ndarray, first: int = 0) -> None:
    """exp of ``s`` plus what ``rel`` gives for the distance, up to a factor a row; 0 for later places.

    ``s`` has the places from ``first`` on, against all.
    """
    if max(s.max(), -s.min()) + np.abs(rel).max() < 60:
        np.exp(s, out=s)
        s *= np.where(_AFTER, np.float32(0), np.exp(rel)[_BACK])[first:]
    else:
        s += rel[_BACK][first:]
        _exp(s, ~_AFTER[first:])


class AttentionModel:
    """Weights of the layer; see ``tables`` for what scoring uses of them."""

    def __init__(self, vocabulary: int, start: int, end: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.v, self.start, self.end = vocabulary, start, end
        self.classes = (mixed(np.arange(vocabulary, dtype=np.uint64)) % np.uint64(CLASSES)).astype(np.int64)
        f = np.float32
        self.p = {
            "x": np.zeros((vocabulary, WIDTH), f), "q": r.normal(0, 0.2, (WIDTH, KEY)).astype(f), "k": r.normal(0, 0.2, (WIDTH, KEY)).astype(f),
            "val": r.normal(0, 0.2, (WIDTH, WIDTH)).astype(f), "rel": np.zeros(WINDOW, f), "out": r.normal(0, 0.1, (WIDTH, CLASSES)).astype(f),
            "direct": r.normal(0, 0.1, (WIDTH, CLASSES)).astype(f), "bias": np.zeros(CLASSES, f),
        }
        #: running sums of squared gradients
        self.sums = {k: np.full_like(w, 1e-4) for k, w in self.p.items()}

    def set_classes(self, near: np.ndarray, rounds: int = 12, seed: int = 7) -> None:
        """Clusters ids by their counts in contexts (contexts x ids); also the first embeddings."""
        count = near.sum(0)
        seen = np.flatnonzero(count)
        if not len(seen):
            return
        count = count[seen].astype(np.float64)
        m = np.sqrt(near[:, seen].T / count[:, None])
        m -= (m * count[:, None]).sum(0) / count.sum()
        gram = (m * count[:, None]).T @ m
        e = (m @ np.linalg.eigh(gram)[1][:, ::-1][:, :WIDTH]).astype(np.float32)
        self.p["x"][seen] = e / max(np.sqrt((e * e).mean()), 1e-6) * 0.5
        weight = np.sqrt(count)
        r = np.random.default_rng(seed)
        center = e[r.choice(len(seen), CLASSES, p=weight / weight.sum())]
        for _ in range(rounds):
            own = ((center**2).sum(1)[None, :] - 2 * e @ center.T).argmin(1)
            for c in range(CLASSES):
                w = weight[own == c]
                if len(w):
                    center[c] = (e[own == c] * w[:, None]).sum(0) / w.sum()
        self.classes[seen] = own

    def fit(self, windows: np.ndarray, lens: np.ndarray, passes: int = 1, batch: int = 128, rate: float = 0.1, seed: int = 7) -> np.ndarray:
        """AdaGrad on the class loss of windows of WINDOW + 1 ids, ``lens`` of them real.

        Gives how often each id was met.
        """
        r = np.random.default_rng(seed)
        for _ in range(passes):
            order = r.permutation(len(windows))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                self._step(windows[rows].astype(np.int64), lens[rows], rate)
        ids = windows[:, :-1][np.arange(WINDOW) < lens[:, None] - 1]
        return np.bincount(ids, minlength=self.v)

    def _step(self, tokens: np.ndarray, lens: np.ndarray, rate: float) -> None:
        """One batch. Matrices that meet the same rows lie side by side, so each product is made
        once: an id's query, key, value and a one; a place's attended value, embedding and a one.

        Attention stays unnormalized (``s``): its sums come with the values, by the column of
        ones, and the backward pass takes them with the gradients of what was attended.
        """
        p, (n, t) = self.p, (len(tokens), WINDOW)
        ok = ((np.arange(t) < lens[:, None] - 1) / np.float32(max(1, n))).astype(np.float32).reshape(-1)
        inp, want = tokens[:, :-1].reshape(-1), self.classes[tokens[:, 1:].reshape(-1)]
        scale, value = np.float32(KEY**-0.5), 2 * KEY
        own = np.concatenate([p["q"] * scale, p["k"], p["val"]], axis=1)
        top = np.concatenate([p["out"], p["direct"], p["bias"][None, :]])
        y = np.ones((n * t, 2 * WIDTH + 1), np.float32)
        x = p["x"].take(inp, axis=0)
        y[:, WIDTH:-1] = x
        h = np.ones((n, t, value + WIDTH + 1), np.float32)
        h[:, :, :-1] = (x @ own).reshape(n, t, -1)
        q, k, v = h[:, :, :KEY], h[:, :, KEY:value], h[:, :, value:]
        s = q @ k.transpose(0, 2, 1)
        _exp_back(s, p["rel"])
        a = (s @ v).reshape(n * t, -1)
        total = a[:, -1:]
        y[:, :WIDTH] = a[:, :-1] / total
        d = y @ top
        _exp(d)
        d *= (ok / (d @ np.ones(CLASSES, np.float32)))[:, None]
        d.reshape(-1)[np.arange(n * t) * CLASSES + want] -= ok
        g_top, dy = y.T @ d, d @ top[:-1].T
        da = np.empty((n * t, WIDTH + 1), np.float32)
        np.divide(dy[:, :WIDTH], total, out=da[:, :-1])
        np.negative(np.einsum("ij,ij->i", da[:, :-1], y[:, :WIDTH]), out=da[:, -1])
        da = da.reshape(n, t, -1)
        dh = np.empty((n, t, value + WIDTH), np.float32)
        dh[:, :, value:] = s.transpose(0, 2, 1) @ da[:, :, :-1]
        s *= da @ v.transpose(0, 2, 1)  # now the gradients of what exp was taken of
        dh[:, :, :KEY], dh[:, :, KEY:value] = s @ k, s.transpose(0, 2, 1) @ q
        dh = dh.reshape(n * t, -1)
        g_own = x.T @ dh
        g = {
            "out": g_top[:WIDTH], "direct": g_top[WIDTH:-1], "bias": g_top[-1], "rel": np.bincount(_BACK.reshape(-1), s.sum(0).reshape(-1), WINDOW).astype(np.float32),
            "q": g_own[:, :KEY] * scale, "k": g_own[:, KEY:value], "val": g_own[:, value:],
        }
        dx = dh @ own.T
        dx += dy[:, WIDTH:]
        order = np.argsort(inp.astype(np.uint16), kind="stable")
        ids = inp[order]
        edge = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows, gx = ids[edge], np.add.reduceat(dx.take(order, axis=0), edge)
        self.sums["x"][rows] += gx * gx
        p["x"][rows] -= rate * gx / np.sqrt(self.sums["x"][rows])
        for name, w in g.items():
            self.sums[name] += w * w
            p[name] -= rate * w / np.sqrt(self.sums[name])

    def parts(self, met: np.ndarray, windows: int) -> list[tuple[int, bytes, bytes]]:
        """(slice, weights, values) rows: what a task sends of its weights; slice -1 is all but ``x``."""
        out = [(-1, np.float64([windows]).tobytes(), b"".join([w.astype(np.float64).tobytes() for part in (self.p, self.sums) for k, w in part.items() if k != "x"]))]
        both = np.concatenate([self.p["x"], self.sums["x"]], axis=1).astype(np.float64)
        for k in range(0, self.v, SLICE):
            there = np.flatnonzero(met[k : k + SLICE])
            if len(there):
                out.append((k, np.concatenate([there, met[k + there]]).astype(np.float64).tobytes(), both[k + there].tobytes()))
        return out

    def take(self, part: int, data: bytes, ids: np.ndarray) -> None:
        """Takes the averaged values of a slice."""
        values = np.frombuffer(data)
        if part >= 0:
            values = values.reshape(len(ids), 2 * WIDTH)
            self.p["x"][part + ids], self.sums["x"][part + ids] = values[:, :WIDTH], values[:, WIDTH:]
            return
        at = 0
        for own in (self.p, self.sums):
            for k, w in own.items():
                if k != "x":
                    own[k] = values[at : at + w.size].reshape(w.shape).astype(np.float32)
                    at += w.size

    def tables(self, pairs: np.ndarray, smooth: float = 0.1, prior: float = 5.0) -> dict[str, np.ndarray]:
        """What scoring looks up by id; ``pairs`` are the counts of all training texts.

        An id's share of its class is counted after ids of the class before it, drawn
        towards its share over all contexts by ``prior`` counts.
        """
        p, c = self.p, pairs.sum(0) + smooth
        share = c / np.bincount(self.classes, c, CLASSES)[self.classes]
        by_class = np.stack([np.bincount(self.classes, x, CLASSES) for x in pairs])
        within = np.log((pairs + prior * share) / (by_class[:, self.classes] + prior)).astype(np.float32)
        return {
            "rows": np.concatenate([p["x"] @ p["q"] * KEY**-0.5, p["x"] @ p["k"], p["x"] @ p["val"], p["x"]], axis=1),
            "top": np.concatenate([p["out"], p["direct"]]), "bias": p["bias"], "rel": p["rel"], "class": self.classes, "within": within,
        }


def attention_scores(ids: list[np.ndarray], t: dict[str, np.ndarray], start: int, end: int, block: int = 128) -> np.ndarray:
    """log10 probability of each text, its end included; overlapping windows in blocks.

    All of a text's first window counts, then what lies beyond the overlap: other places are not computed.
    """
    lens = np.array([len(x) + 1 for x in ids])
    gaps = np.zeros(WINDOW + 1, np.int64)
    flat = np.concatenate([y for x in ids for y in ([start], x.astype(np.int64), [end])] + [gaps])
    base = np.cumsum(lens + 1) - lens - 1
    n = np.maximum(0, -(-(lens - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(ids)), n)
    at = (1 + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    out = np.zeros(len(ids))
    top = np.concatenate([t["top"][WIDTH:], t["bias"][None, :], t["top"][:WIDTH]])
    value = 2 * KEY  # an id's row holds its query, key, value and embedding
    for own, begin, first in ((np.arange(len(ids)), np.zeros(len(ids), np.int64), 0), (doc, at, WINDOW - STRIDE)):
        places = np.arange(first, WINDOW)
        for k in range(0, len(own), block):
            some, lead = own[k : k + block], begin[k : k + block]
            tokens = flat[(base[some] + lead)[:, None] + np.arange(WINDOW + 1)]
            used = lead[:, None] + places < lens[some][:, None]
            out += np.bincount(some, np.where(used, _log_shares(tokens, t, top, first, value), 0).sum(1), len(ids))
    return out / LOG10


def _log_shares(tokens: np.ndarray, t: dict[str, np.ndarray], top: np.ndarray, first: int, value: int) -> np.ndarray:
    """Log probabilities of the ids of windows after their places from ``first`` on."""
    n, size = len(tokens), WINDOW - first
    m = n * size
    inp, nxt, now = tokens[:, :-1], tokens[:, first + 1 :], tokens[:, first:-1]
    h = t["rows"].take(inp, axis=0, out=_room("h", n, WINDOW, value + 2 * WIDTH), mode="clip")
    s = np.matmul(h[:, first:, :KEY], h[:, :, KEY:value].transpose(0, 2, 1), out=_room("s", n, size, WINDOW))
    _exp_back(s, t["rel"], first)
    a = np.matmul(s, h[:, :, value : value + WIDTH], out=_room("a", n, size, WIDTH))
    a *= 1 / s.reshape(m, WINDOW).dot(_ONES[:WINDOW]).reshape(n, size, 1)
    y = _room("y", n, size, 2 * WIDTH + 1)
    y[:, :, :WIDTH], y[:, :, WIDTH], y[:, :, WIDTH + 1 :] = h[:, first:, value + WIDTH :], 1, a
    z = np.matmul(y.reshape(m, -1), top, out=_room("d", m, CLASSES))
    want = z.take(np.arange(0, m * CLASSES, CLASSES).reshape(n, size) + t["class"].take(nxt))
    if max(z.max(), -z.min()) >= 60:
        most = z.max(1, keepdims=True)
        z -= most
        want -= most.reshape(n, size)
    np.exp(z, out=z)
    return want - np.log(z.dot(_ONES)).reshape(n, size) + t["within"].take(t["class"].take(now) * t["within"].shape[1] + nxt)


def subword_ids(docs: DataFrame, tokenizer_path: str, common: np.ndarray, common_log: np.ndarray, memo: int) -> DataFrame:
    """``docs`` (id, learn, text) with key, n_words, sums over common words, the rarer words and ids in place of text.

    ``key`` numbers the rows; it holds once the result is written. ids are unsigned 16-bit.
    """

    def run(batches):
        encoder = chunk_encoder(tokenizer_path, memo)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in text_slices(batch, "text", chars=1_000_000, rows=512):
                h, codes, n_words = distinct_hashes(texts)
                hit, log = np.zeros(len(h), bool), np.zeros(len(h))
                if len(h) and len(common):
                    place = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    hit = common[place] == h
                    log[hit] = common_log[place[hit]]
                owner, hit, log = np.repeat(np.arange(len(texts)), n_words), hit[codes], log[codes]
                known = np.bincount(owner[hit], minlength=len(texts))
                rare, cuts = h[codes[~hit]].tobytes(), (8 * np.cumsum([0, *(n_words - known)])).tolist()
                cols = [pa.array(key + np.arange(len(texts))), pa.array(n_words), pa.array(np.bincount(owner, log, len(texts)).astype(np.float64)), pa.array(known)]
                key += len(texts)
                cols += [pa.array(c, pa.binary()) for c in ([rare[a:b] for a, b in zip(cuts, cuts[1:])], [_narrow(x) for x in encoder.encode(texts)])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(texts)) for c in ("id", "learn")), *cols], names=["id", "learn", "key", "n_words", "common_log", "common_known", "words", "ids"])

    return docs.select("id", "learn", "text").mapInArrow(releasing(run), f"id {docs.schema['id'].dataType.simpleString()}, learn boolean, key long, n_words long, common_log double, common_known long, words binary, ids binary")


def _narrow(ids: bytes) -> bytes:
    return np.frombuffer(ids, np.uint32).astype(np.uint16).tobytes()


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.uint16).astype(np.int64)


def pair_counts(rows: DataFrame, model: AttentionModel, slots: np.ndarray, back: bool = False) -> np.ndarray:
    """(slot, id): how often each id, the end too, follows ids of each slot in ``rows.ids``.

    With ``back`` as many rows again: how often each id stands before ids of each slot.
    The result's size depends on the vocabulary alone; tasks send one row a slot.
    """
    start, end, v = model.start, model.end, model.v
    n_slots = CLASSES * (1 + back)
    end_mark = v  # a text's end, which an id within the text can't be taken for
    first, last = np.array([start], np.int32), np.array([end_mark], np.int32)

    def partial(batches):
        total, held, size = np.zeros((n_slots, v), np.uint32), [], 0  # one task's texts have fewer ids

        def count():
            flat = np.concatenate(held)
            a, b = flat[:-1], flat[1:]
            inside = a != end_mark
            a, b = a[inside], np.where(b[inside] == end_mark, end, b[inside])
            total[:CLASSES] += np.bincount(slots[a] * v + b, minlength=CLASSES * v).reshape(CLASSES, v).astype(np.uint32)
            if back:
                total[CLASSES:] += np.bincount(slots[b] * v + a, minlength=CLASSES * v).reshape(CLASSES, v).astype(np.uint32)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for x in batch.column(0).slice(at, 256).to_pylist():
                    held += [first, np.frombuffer(x, np.uint16), last]
                    size += len(x) // 2 + 2
                if size > 1_000_000:
                    count()
                    held, size = [], 0
        if held:
            count()
        if total.any():
            yield packed({k: x for k, x in enumerate(total) if x.any()})

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, ids, n in zip(*(c.to_pylist() for c in batch.columns)):
                if k not in total:
                    total[k] = np.zeros(v, np.int64)
                total[k][np.frombuffer(ids, np.uint32)] += np.frombuffer(n, np.int64)
        if total:
            yield packed(total)

    def packed(total: dict[int, np.ndarray]):
        there = {k: np.flatnonzero(x) for k, x in total.items()}
        cols = [list(total), [there[k].astype(np.uint32).tobytes() for k in total], [total[k][there[k]].astype(np.int64).tobytes() for k in total]]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["slot", "ids", "n"])

    schema = "slot int, ids binary, n binary"
    out = np.zeros((n_slots, v), np.int64)
    for r in rows.select("ids").mapInArrow(releasing(partial), schema).repartition("slot").mapInArrow(added, schema).collect():
        out[r["slot"], np.frombuffer(r["ids"], np.uint32)] = np.frombuffer(r["n"], np.int64)
    return out


def training_windows(rows: DataFrame, model: AttentionModel, rounds: int) -> DataFrame:
    """(round, n, tokens, lens): all windows of all texts, dealt to the rounds by hash."""
    head, tail = (np.array([x], np.uint16).tobytes() for x in (model.start, model.end))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(at, 256).to_pylist()
                size = np.array([len(x) // 2 + 2 for x in texts])
                flat = np.frombuffer(b"".join([y for x in texts for y in (head, x, tail)]), np.uint16)
                begin, n = np.cumsum(size) - size, -(-(size - 1) // WINDOW)
                doc = np.repeat(np.arange(len(texts)), n)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                salt = np.array([crc32(x) for x in texts], np.uint64) << np.uint64(32)
                h = mixed(nth.astype(np.uint64) + salt[doc], 3)
                step = ((h >> np.uint64(40)) % np.uint64(rounds)).astype(np.int64)
                order = np.argsort(step, kind="stable")
                doc, nth, step = doc[order], nth[order], step[order]
                lens = np.minimum(WINDOW + 1, size[doc] - nth * WINDOW)
                place = (begin[doc] + nth * WINDOW)[:, None] + np.minimum(np.arange(WINDOW + 1), lens[:, None] - 1)
                tokens, lens = flat[place], lens.astype(np.uint8)
                edge = np.flatnonzero(np.diff(step, prepend=-1, append=-1)) if len(step) else np.zeros(1, np.int64)
                spans = list(zip(edge[:-1], edge[1:]))
                if spans:
                    columns = [int(step[a]) for a, _ in spans], [int(b - a) for a, b in spans], [tokens[a:b].tobytes() for a, b in spans], [lens[a:b].tobytes() for a, b in spans]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["round", "n", "tokens", "lens"])

    return rows.select("ids").mapInArrow(run, "round int, n long, tokens binary, lens binary")


def train(rows: DataFrame, model: AttentionModel, rounds: int = 3, per_task: int = 20_000) -> AttentionModel:
    """Fits the weights on all windows of all texts, each once.

    A round's windows are dealt to tasks of about ``per_task`` windows, which train from
    the same weights; then the weights are averaged by slices of ids. What reaches the
    driver depends on the vocabulary alone.
    """
    windows = written(training_windows(rows, model, rounds), "windows")
    sizes = {r["round"]: r["n"] for r in windows.groupBy("round").agg(F.sum("n").alias("n")).collect()}
    schema = "slice int, weights binary, data binary"

    def added(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, w, data in zip(*(c.to_pylist() for c in batch.columns)):
                w, data = np.frombuffer(w), np.frombuffer(data)
                if k < 0:
                    at, n, data = np.zeros(1, np.int64), w, data[None, :]
                else:
                    at, n, data = w[: len(w) // 2].astype(np.int64), w[len(w) // 2 :], data.reshape(len(w) // 2, -1)
                if k not in held:
                    held[k] = np.zeros(SLICE if k >= 0 else 1), np.zeros((SLICE if k >= 0 else 1, data.shape[1]))
                held[k][0][at] += n
                held[k][1][at] += data * n[:, None]
        for k, (n, data) in held.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([there.astype(np.int64).tobytes()], pa.binary()), pa.array([(data[there] / n[there, None]).tobytes()], pa.binary())], names=["slice", "weights", "data"])

    for step in sorted(sizes):
        tasks = max(1, -(-sizes[step] // per_task))

        def run(batches, step=step):
            tokens, lens = [], []
            for batch in batches:
                tokens += [np.frombuffer(x, np.uint16).reshape(-1, WINDOW + 1) for x in batch.column(0).to_pylist()]
                lens += [np.frombuffer(x, np.uint8) for x in batch.column(1).to_pylist()]
            if tokens:
                tokens, lens = np.concatenate(tokens), np.concatenate(lens).astype(np.int64)
                met = model.fit(tokens, lens, seed=step)
                cols = list(zip(*model.parts(met, len(lens))))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["slice", "weights", "data"])

        dealt = windows.filter(F.col("round") == step).select("tokens", "lens").repartition(tasks, F.xxhash64("tokens"))
        for r in dealt.mapInArrow(releasing(run), schema).repartition("slice").mapInArrow(added, schema).collect():
            model.take(r["slice"], r["data"], np.frombuffer(r["weights"], np.int64))
    return model


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(h, c): how often each word, as a hash, occurs in all texts."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            h, at = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            return h, np.bincount(at, np.concatenate([b for _, b in held])).astype(np.int64)

        def batch_of(h, c):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "c"])

        size = 0
        for batch in batches:
            for _, texts in text_slices(batch, "text", chars=1_000_000, rows=512):
                h, codes, _ = distinct_hashes(texts)
                held.append((h, np.bincount(codes, minlength=len(h))))
                size += len(h)
                if size > 2_000_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merged())

    return docs.select(F.col(text_col).alias("text")).mapInArrow(releasing(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


_DEALT = "bucket long, kind int, keys binary, sizes binary, words binary, times binary"


def _dealt(bucket: np.ndarray, kind: int, *columns: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([kind] * len(bucket), pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "kind", "keys", "sizes", "words", "times"])


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _rare_words(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind 1, keys, sizes, words, times): the rarer words of many rows, packed."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                keys, words = batch.column(0).slice(at, 2048).to_numpy(), [np.frombuffer(x, np.uint64) for x in batch.column(1).slice(at, 2048).to_pylist()]
                owner, words = np.repeat(np.arange(len(words)), [len(x) for x in words]), np.concatenate(words)
                bucket = (words % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, owner, words = bucket[order], owner[order], words[order]
                edge, out = _edges(bucket), []
                for a, b in zip(edge[:-1], edge[1:]):
                    cut = _edges(owner[a:b])
                    out.append((keys[owner[a:b][cut[:-1]]].tobytes(), np.diff(cut).astype(np.uint32).tobytes(), words[a:b].tobytes(), b""))
                if out:
                    yield _dealt(bucket[edge[:-1]], 1, *map(list, zip(*out)))

    return rows.select("key", "words").mapInArrow(run, _DEALT)


def _packed_counts(counts: DataFrame, buckets: int) -> DataFrame:
    """The counts of the rarer words, packed by bucket in rows of kind 0."""

    def run(batches):
        for batch in batches:
            h, c = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, h, c = bucket[order], h[order], c[order]
            edge = _edges(bucket)
            spans, empty = list(zip(edge[:-1], edge[1:])), [b""] * (len(edge) - 1)
            yield _dealt(bucket[edge[:-1]], 0, empty, empty, [h[a:b].tobytes() for a, b in spans], [c[a:b].astype(np.int64).tobytes() for a, b in spans])

    return counts.select("h", "c").mapInArrow(run, _DEALT)


def _rare_sums(dealt: DataFrame, smooth: float, key_buckets: int) -> DataFrame:
    """(key, rare_log, rare_known): sums over a row's rarer words.

    A bucket's counts come first; its words are looked up as they come. A task's sums
    go on packed by a hash of the key, a row for each bucket of keys, and are added up
    there.
    """

    def run(batches):
        sums: dict[int, list] = {}
        at, known, table = None, [], None

        def looked_up(words: np.ndarray) -> np.ndarray:
            nonlocal table
            if table is None:
                h, c = (np.concatenate([x[k] for x in known]) for k in (0, 1)) if known else (np.empty(0, np.uint64), np.empty(0, np.int64))
                order = np.argsort(h)
                table = h[order], c[order]
            h, c = table
            if not len(h):
                return np.zeros(len(words), np.int64)
            place = np.minimum(np.searchsorted(h, words), len(h) - 1)
            return np.where(h[place] == words, c[place], 0)

        def out():
            keys, both = np.fromiter(sums, np.int64, len(sums)), np.array(list(sums.values()))
            kb = keys % key_buckets
            order = np.argsort(kb, kind="stable")
            kb, keys, both = kb[order], keys[order], both[order]
            edge = np.flatnonzero(np.concatenate([[True], kb[1:] != kb[:-1], [True]]))
            rows = [(int(kb[a]), keys[a:b].tobytes(), both[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["kb", "keys", "sums"])

        for batch in batches:
            for b, kind, keys, sizes, words, times in zip(*(c.to_pylist() for c in batch.columns)):
                if b != at:
                    at, known, table = b, [], None
                if kind == 0:
                    known.append((np.frombuffer(words, np.uint64), np.frombuffer(times, np.int64)))
                    continue
                sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
                count, first = looked_up(np.frombuffer(words, np.uint64)), np.cumsum(sizes) - sizes
                logs, known_n = np.add.reduceat(np.log10(count + smooth), first), np.add.reduceat((count > 0).astype(np.int64), first)
                for k, x, y in zip(np.frombuffer(keys, np.int64).tolist(), logs.tolist(), known_n.tolist()):
                    got = sums.get(k)
                    if got:
                        got[0] += x
                        got[1] += y
                    else:
                        sums[k] = [x, y]
                if len(sums) > 200_000:
                    yield out()
                    sums = {}
        if sums:
            yield out()

    def added(batches):
        at, held = None, []

        def close():
            keys, where = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
            both = np.concatenate([b for _, b in held])
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(where, both[:, 0])), pa.array(np.rint(np.bincount(where, both[:, 1])).astype(np.int64))], names=["key", "rare_log", "rare_known"])

        for batch in batches:
            for kb, keys, sums in zip(*(c.to_pylist() for c in batch.columns)):
                if kb != at and held:
                    yield close()
                    held = []
                at = kb
                held.append((np.frombuffer(keys, np.int64), np.frombuffer(sums).reshape(-1, 2)))
        if held:
            yield close()

    packed = dealt.mapInArrow(run, "kb long, keys binary, sums binary")
    return packed.repartition("kb").sortWithinPartitions("kb").mapInArrow(added, "key long, rare_log double, rare_known long")


def learned(rows: DataFrame, vocabulary: int, start: int, end: int) -> tuple[AttentionModel, np.ndarray]:
    """The model of all texts in ``rows.ids``, and their counts of ids after each class."""
    model = AttentionModel(vocabulary, start, end)
    model.set_classes(pair_counts(rows, model, model.classes, back=True))
    train(rows, model)
    return model, pair_counts(rows, model, model.classes)


def lm_scores(docs: DataFrame, learn: Column, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", smooth: float = 0.1, share: float = 1e-6, words_per_bucket: int = 1_000_000, memo: int = 700_000) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` picks the training rows (null counts as no). Base tokens are words and
    one end; ``base_score`` sums log10((c + smooth) / (N + smooth * (V + 1))).
    ``score`` is the attention model's log10 probability of the text's subword ids and
    end. Null and empty texts have the end alone. Without training rows all counts
    are 0. Counts and windows come from all training rows. Rows stay as many as they
    are; ids may be null or repeated. The vocabulary must have at most 65,536 ids.
    """
    import json

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    if vocabulary > 1 << 16:
        raise ValueError("the vocabulary must have at most 65536 ids")
    start, end = (sorted(t["id"] for t in spec["added_tokens"]) * 2)[:2] if spec["added_tokens"] else (0, 0)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))

    counts = written(word_counts(base.filter("learn"), "text"), "word-counts")
    n_docs = base.filter("learn").count()
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = facts["n"] + n_docs, facts["v"] + (n_docs > 0)
    least = max(1, math.ceil(share * total))
    often = counts.filter(F.col("c") >= least).toArrow()  # at most 1 / share rows
    common, times = often.column("h").to_numpy().view(np.uint64), often.column("c").to_numpy()
    order = np.argsort(common)
    common, common_log = common[order], np.log10(times[order] + smooth)

    rows = written(subword_ids(base, tokenizer_path, common, common_log, memo), "subwords")
    # at most so many words are dealt, those of the other rows too
    rare = rows.agg(F.coalesce(F.sum((F.length("words") / 8).cast("long")), F.lit(0))).first()[0] + facts["v"]
    buckets = max(1, math.ceil(rare / words_per_bucket)) * 8
    dealt = _packed_counts(counts.filter(F.col("c") < least), buckets).unionByName(_rare_words(rows, buckets))
    key_buckets = max(1, math.ceil(rows.count() / 50_000)) * 32
    rare = _rare_sums(dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind"), smooth, key_buckets)

    model, pairs = learned(rows.filter("learn").select("ids"), vocabulary, start, end)
    tables = model.tables(pairs)

    def score(batches):
        for batch in batches:
            ids, at = batch.column("ids"), 0
            while at < len(ids):
                some, size = [], 0
                for x in ids.slice(at, 256).to_pylist():
                    some.append(_wide(x))
                    size += len(some[-1])
                    if size > 500_000:
                        break
                got = attention_scores(some, tables, start, end)
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(got, pa.float64())], names=[*names, "score"])
                at += len(some)

    names = ["id", "key", "n_words", "common_log", "common_known"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, key long, n_words long, common_log double, common_known long, score double"
    scored = rows.select(*names, "ids").mapInArrow(releasing(score), schema).join(rare, "key", "left")
    n_tokens = F.col("n_words") + 1
    log = F.col("common_log") + F.coalesce("rare_log", F.lit(0.0)) + math.log10(n_docs + smooth) - n_tokens * math.log10(total + smooth * (distinct + 1))
    known = F.col("common_known") + F.coalesce("rare_known", F.lit(0)) + int(n_docs > 0)
    return scored.select(F.col("id").alias(id_col), n_tokens.alias("n_tokens"), known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), log.alias("base_score"), "score")
