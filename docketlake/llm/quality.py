"""Document quality by a byte-level convolutional network in numpy.

A byte's symbol also says whether the eight bytes up to it repeat what stands 2 to
32 bytes before. Symbols are embedded and convolved with learned filters over overlapping chunks that
cover the whole document; each filter is max-pooled within a chunk, and the
maximum and the mean over a document's chunks go into one logistic output.

Training uses a bounded sample of labelled rows (``train_docs``, the only bound):
the rows with the smallest hash of their id. Scoring reads every byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import releasing, text_slices

CHUNK, OVERLAP, STRIDE, EMBED, FILTERS = 512, 64, 4, 8, 16
WIDTH = 2 * STRIDE
_STEP = CHUNK - OVERLAP
_ROWS = CHUNK // STRIDE


def symbols(data: bytes, lags: range = range(2, 33)) -> np.ndarray:
    """The bytes, plus 256 where the last eight repeat those ``lag`` bytes before."""
    x = np.frombuffer(data, np.uint8)
    again = np.zeros(len(x), bool)
    for lag in lags:
        if len(x) < lag + 8:
            break
        e = x[lag:] == x[:-lag]
        e = e[1:] & e[:-1]
        e = e[2:] & e[:-2]
        again[lag + 7 :] |= e[4:] & e[:-4]
    return x + again.astype(np.uint16) * np.uint16(256)


def chunks(data: bytes) -> np.ndarray:
    """Overlapping chunks of CHUNK symbols that cover all of ``data``; zeros fill the last."""
    n = max(1, -(-max(0, len(data) - OVERLAP) // _STEP))
    padded = np.zeros((n - 1) * _STEP + CHUNK, np.uint16)
    padded[: len(data)] = symbols(data)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::_STEP]


class ByteConvNet:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (512, EMBED)).astype(np.float32),
            "conv": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "top": np.zeros(FILTERS, np.float32),
            "mean": np.zeros(FILTERS, np.float32),
            "out": np.zeros(1, np.float32),
        }

    def pooled(self, block: np.ndarray, where: bool = False):
        """Max of each filter in each chunk (n, FILTERS), with its row if asked."""
        p, half = self.p, STRIDE * EMBED
        both = np.concatenate([p["conv"][:half], p["conv"][half:]], axis=1)
        top, at = [], []
        for k in range(0, len(block), 64):
            part = block[k : k + 64]
            y = (p["embed"][part].reshape(-1, half) @ both).reshape(len(part), _ROWS, 2 * FILTERS)
            z = y[:, :-1, :FILTERS] + y[:, 1:, FILTERS:]
            top.append(z.max(1))
            if where:
                at.append(z.argmax(1))
        top = np.maximum(np.concatenate(top) + p["bias"], 0)
        return (top, np.concatenate(at)) if where else top

    def logits(self, top: np.ndarray, starts: np.ndarray):
        n = np.diff(np.append(starts, len(top)))[:, None]
        most, mean = np.maximum.reduceat(top, starts), np.add.reduceat(top, starts) / n
        return most @ self.p["top"] + mean @ self.p["mean"] + self.p["out"][0], most, mean, n

    def score(self, texts: list[str]) -> np.ndarray:
        parts = [chunks(x.encode("utf-8", "replace")) for x in texts]
        starts = np.cumsum([0, *map(len, parts[:-1])])
        z = self.logits(np.concatenate([self.pooled(x) for x in _grouped(parts)]), starts)[0]
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def fit(self, texts: list[str], labels: list[int], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteConvNet:
        """Adam on the logistic loss; every epoch takes all chunks of every text."""
        r, y = np.random.default_rng(seed), np.asarray(labels, np.float32)
        if not texts:
            return self
        parts = [chunks(x.encode("utf-8", "replace")) for x in texts]
        share = float(np.clip(y.mean(), 0.01, 0.99))
        self.p["out"][0] = np.log(share / (1 - share))
        if len(set(labels)) < 2:
            return self
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.p["top"] += r.normal(0, 0.1, FILTERS).astype(np.float32)
        self.p["mean"] += r.normal(0, 0.1, FILTERS).astype(np.float32)
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                g = self._gradient([parts[i] for i in rows], y[rows])
                step += 1
                for name, v in self.p.items():
                    a, b = m[name]
                    a += 0.1 * (g[name] - a)
                    b += 0.01 * (g[name] ** 2 - b)
                    v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        return self

    def _gradient(self, used: list[np.ndarray], y: np.ndarray, most: int = 2048) -> dict[str, np.ndarray]:
        """Gradient of the loss on some texts; their chunks are passed ``most`` at a time."""
        p = self.p
        lens = np.array([len(x) for x in used])
        starts = np.cumsum(lens) - lens
        blocks = list(_grouped(used, most))
        top, at = map(np.concatenate, zip(*[self.pooled(x, True) for x in blocks]))
        z, high, mean, n = self.logits(top, starts)
        d = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)
        doc = np.repeat(np.arange(len(used)), lens)
        # the gradient of the maximum goes to the chunk that has it, that of the mean to all
        hit = top == high[doc]
        dt = d[doc, None] * (p["mean"] / n[doc] + hit / np.maximum(1, np.add.reduceat(hit, starts)[doc]) * p["top"])
        dt *= top > 0
        g = {"top": d @ high, "mean": d @ mean, "out": np.array([d.sum()], np.float32), "bias": dt.sum(0), "conv": np.zeros_like(p["conv"]), "embed": np.zeros_like(p["embed"])}
        begin = 0
        for whole in blocks:
            for block in (whole[k : k + most] for k in range(0, len(whole), most)):
                end = begin + len(block)
                i, f = np.nonzero(dt[begin:end])
                v = dt[begin:end][i, f]
                window = block[i[:, None], at[begin:end][i, f][:, None] * STRIDE + np.arange(WIDTH)]
                x = p["embed"][window].reshape(len(i), WIDTH * EMBED)
                g["conv"] += np.stack([v[f == c] @ x[f == c] for c in range(FILTERS)], axis=1)
                back = (v[:, None] * p["conv"].T[f]).reshape(-1, EMBED)
                g["embed"] += np.stack([np.bincount(window.reshape(-1), back[:, c], 512) for c in range(EMBED)], axis=1).astype(np.float32)
                begin = end
        return g


def _grouped(parts: list[np.ndarray], most: int = 512):
    """Chunks of neighbouring texts together, ``most`` or one text's a time."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x)
        if n >= most:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = 2000) -> ByteConvNet:
    """A network fitted on at most ``train_docs`` rows, taken by a hash of the id.

    The labels are picked first, so only that many texts are looked for. Rows with a
    null label play no part, null texts count as empty. Without rows every score is
    0.5, with one label all scores are near its side.
    """
    h = F.xxhash64(F.col(id_col).cast("string"))
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"), h.alias("h"))
    picked = known.orderBy("h", "label").limit(train_docs)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "_id")
    sample = rows.select("h", "text", "label").orderBy("h", "text", "label").limit(train_docs).collect()
    return ByteConvNet().fit([r["text"] for r in sample], [min(1, max(0, r["label"])) for r in sample])


def score_quality(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` ids with score (0 to 1); null texts count as empty, rows stay as they are."""

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(net.score(texts), pa.float64())], names=[id_col, "score"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(releasing(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_quality(docs: DataFrame, net: ByteConvNet, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns."""

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch, text_col):
                kept = net.score(texts) >= least
                if kept.any():
                    yield batch.slice(at, len(texts)).filter(pa.array(kept))

    return docs.mapInArrow(releasing(run), docs.schema)
