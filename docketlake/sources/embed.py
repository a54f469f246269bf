"""Vectors of texts through a pluggable embedder, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 128

#: texts and their use ("document" or "query") to one vector each
Embedder = Callable[[list[str], str], list]


class HashingEmbedder:
    """A deterministic stand-in for a model: signed hashed word counts, unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: list[str], use: str) -> list:
        from zlib import crc32

        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = crc32(word.encode())
                row[h % self.dimension] += 1.0 if h & 0x80000000 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return list(out / np.where(size > 0, size, 1))


def embed(rows: DataFrame, embedder: Embedder, text_col: str = "content", as_: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``rows`` with vectors of their texts; at most ``batch`` texts go to a call."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            got = [v for k in range(0, len(texts), batch) for v in embedder(texts[k : k + batch], "document")]
            yield pd.Series([[float(x) for x in v] for v in got], dtype=object)

    return rows.withColumn(as_, vectors(F.col(text_col)))


def embed_query(text: str, embedder: Embedder) -> list[float]:
    if not text.strip():
        raise ValueError("a query is required")
    return [float(x) for x in embedder([text], "query")[0]]


#: texts and their use to (index, vector) replies, in any order and perhaps not all
IndexedEmbedder = Callable[[list[str], str], list[tuple[int, list]]]


def placed(texts: list[str], ask: IndexedEmbedder, use: str = "document", tries: int = 3) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text, each vector at the index that its reply names.

    Texts without a reply are asked again, up to ``tries`` times. A request that fails is
    halved until the text that fails is alone; alone it is tried again before it counts as bad.
    """
    out: list = [None] * len(texts)

    def request(at: list[int], left: int) -> None:
        try:
            replies = ask([texts[k] for k in at], use)
        except Exception as e:
            if len(at) > 1:
                request(at[: len(at) // 2], left)
                request(at[len(at) // 2 :], left)
            elif left > 1:
                request(at, left - 1)
            else:
                out[at[0]] = (None, str(e) or type(e).__name__)
            return
        for index, vector in replies:
            if 0 <= index < len(at) and out[at[index]] is None:
                out[at[index]] = ([float(x) for x in vector], None)
        missing = [k for k in at if out[k] is None]
        if missing and left > 1:
            request(missing, left - 1)
        for k in missing:
            out[k] = out[k] or (None, "No embedding was returned")

    if texts:
        request(list(range(len(texts))), tries)
    return out


def embed_by_index(rows: DataFrame, ask: IndexedEmbedder, text_col: str = "content", as_: str = "embedding", error_as: str = "embedding_error", batch: int = BATCH, tries: int = 3) -> DataFrame:
    """``rows`` with vectors placed by the index of their replies, and the error of a text that has none.

    A null text is asked for as an empty one. One bad text costs no other its vector.
    """

    @F.pandas_udf("vector array<float>, error string")
    def replies(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part.fillna("").tolist()
            got = [x for k in range(0, len(texts), batch) for x in placed(texts[k : k + batch], ask, "document", tries)]
            yield pd.DataFrame({"vector": pd.Series([v for v, _ in got], dtype=object), "error": pd.Series([e for _, e in got], dtype=object)})

    held = rows.withColumn("_reply", replies(F.col(text_col)))
    return held.withColumns({as_: F.col("_reply.vector"), error_as: F.col("_reply.error")}).drop("_reply")
