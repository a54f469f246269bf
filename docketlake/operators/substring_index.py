"""An index for searches of a substring: postings of three-letter pieces, intersected, then verified.

Every lower-cased text of a row (nested ones too) gives its pieces of three characters,
found in Arrow batches in one pass over the text; a posting is a piece and the keys of
some rows that have it. A search reads the postings of the query's rarest pieces only,
keeps the keys that have all of them, and verifies these rows with the search itself, so
its results are those of a scan. Queries under three characters are a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, PIECES = 32, 4
HELD = 1 << 20  # pairs of a piece and a key that a task holds before it gives out postings
_BITS = np.uint64(21)  # a code point
_LOW = np.uint64((1 << 21) - 1)


def codes(text: str) -> np.ndarray:
    """The distinct pieces of three characters of a text, each as one number; shorter texts have none."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(points) < 3:
        return np.zeros(0, np.uint64)
    return np.unique(points[:-2] << (_BITS + _BITS) | points[1:-1] << _BITS | points[2:])


def shown(numbers: np.ndarray) -> list[str]:
    """The pieces of their numbers."""
    points = np.stack([numbers >> (_BITS + _BITS), numbers >> _BITS & _LOW, numbers & _LOW], axis=1).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    return [text[k : k + 3] for k in range(0, len(text), 3)]


def _postings(keys: list[pa.Array], found: list[np.ndarray]) -> pa.RecordBatch:
    """A row a piece with the keys of the rows that have it; ``found`` has the pieces of each key's row."""
    piece, row = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
    order = np.argsort(piece, kind="stable")
    each, start = np.unique(piece[order], return_index=True)
    held = pa.concat_arrays(keys).take(pa.array(row[order]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(piece)).astype(np.int32)), held)
    return pa.RecordBatch.from_arrays([pa.array(shown(each)), lists], names=["piece", "keys"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (key, texts as bytes), given out whenever enough pairs are held."""
    keys: list[pa.Array] = []
    found: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for at in range(len(batch)):
            texts = batch.column(1)[at].values
            own = [codes(t.as_py().decode("utf-8", "replace")) for t in texts] if texts is not None else []
            own = own[0] if len(own) == 1 else np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
            keys.append(batch.column(0).slice(at, 1))
            found.append(own)
            size += len(own)
            if size >= HELD or len(keys) >= 100_000:
                yield _postings(keys, found)
                keys, found, size = [], [], 0
    if keys:
        yield _postings(keys, found)


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


class SubstringIndex:
    """Postings under ``path`` by bucket of their piece, and how many rows have each piece."""

    def __init__(self, rows: DataFrame, key: str, texts: Column, path: str):
        """Indexes ``rows`` by their unique ``key``; ``texts`` is an array of all texts of a row."""
        self.rows, self.key, self.path = rows, key, path.rstrip("/")
        self.kind = rows.schema[key].dataType.simpleString()
        low = F.transform(F.filter(texts, lambda x: x.isNotNull()), lambda x: F.lower(x).cast("binary"))
        postings = rows.select(F.col(key).alias("key"), low.alias("texts")).mapInArrow(_gathered, f"piece string, keys array<{self.kind}>")
        postings = postings.select("piece", "keys", F.size("keys").alias("n"), _bucket(F.col("piece")).alias("bucket"))
        # a frequent piece is dealt over some files by its keys
        dealt = postings.repartition("bucket", F.pmod(F.xxhash64(F.element_at("keys", 1)), F.lit(8))).sortWithinPartitions("bucket", "piece")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/postings")
        held = self._read("postings", "n int").groupBy("bucket", "piece").agg(F.sum("n").alias("n"))
        held.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/counts")

    def _read(self, what: str, columns: str) -> DataFrame:
        return self.rows.sparkSession.read.schema(f"piece string, {columns}, bucket int").parquet(f"{self.path}/{what}")

    def postings(self) -> DataFrame:
        """A row a piece and key."""
        return self._read("postings", f"keys array<{self.kind}>").select("piece", F.explode("keys").alias("key"), "bucket")

    def chosen(self, query: str) -> list[tuple[str, int]] | None:
        """The rarest pieces of a query and their buckets; None: a scan, as the query is too short."""
        spark = self.rows.sparkSession
        low = spark.range(1).select(F.lower(F.lit(query.lower()))).first()[0]
        if len(low) < 3:
            return None
        asked = spark.createDataFrame([(p,) for p in shown(codes(low))], "piece string").select("piece", _bucket(F.col("piece")).alias("bucket")).collect()
        held = self._read("counts", "n long").filter(F.col("bucket").isin([r["bucket"] for r in asked]) & F.col("piece").isin([r["piece"] for r in asked]))
        n = {r["piece"]: r["n"] for r in held.collect()}
        return sorted(((r["piece"], r["bucket"]) for r in asked), key=lambda p: (n.get(p[0], 0), p[0]))[:PIECES]

    def keys(self, chosen: Sequence[tuple[str, int]]) -> DataFrame:
        """The keys of rows that have all the pieces."""
        held = self.postings().filter(F.col("bucket").isin([b for _, b in chosen]) & F.col("piece").isin([p for p, _ in chosen]))
        return held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(chosen)).select("key")

    def search(self, query: str, holds: Callable[[str], Column]) -> DataFrame:
        """The rows for which ``holds(query)`` is true; it must need the query in one of the indexed texts."""
        chosen = self.chosen(query)
        if chosen is None:
            return self.rows.filter(holds(query))
        return self.rows.join(self.keys(chosen), F.col(self.key) == F.col("key"), "left_semi").filter(holds(query))
