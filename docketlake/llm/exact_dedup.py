"""Exact dedup through a log-structured merge index of text digests.

The index is a set of sorted runs of (digest, best id, rows) kept as Parquet in
the shared folder. Memtables are slices of the input; each is aggregated by
digest and flushed as a run sorted by digest, with Parquet min/max statistics
and Bloom filters on the digest. Compaction merges ``fan_in`` runs of a level
into one run of the next level and keeps one identifier a digest, the smallest
or the largest as asked. ``lookup`` asks for single digests, and the runs' filters
skip what can't have them. Over all rows, the digests that the index holds more than
once make one filter, sized by their number; a row that passes it and has such a
digest is a hit, and each hit is compared byte by byte with the text of the row that
stays before it counts as a copy.

Only DataFrame functions are used. Hot groups (a text copied in a third of all
rows) are pre-aggregated before each shuffle, and the byte comparison salts
them: the text that stays is repeated once per ``salt_rows`` copies.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import integral, new_path, written

MOST_BLOCKS = 1 << 21  # of 64 bits: what may be broadcast


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks))


def _bits(digest: Column) -> Column:
    """Two bits of a 64-bit block, taken from a second hash of the digest."""
    h = F.xxhash64(digest, F.lit(7))
    one = F.lit(1).cast("long")
    return F.call_function("shiftleft", one, F.pmod(h, F.lit(64)).cast("int")).bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.shiftright(h, 8), F.lit(64)).cast("int")))


class DigestIndex:
    """Log-structured merge index from digest to (best id, its rows, all rows).

    ``keep`` is ``"min"`` or ``"max"``: which identifier compaction keeps.
    Null ids rank below all others for ``max`` and above them for ``min``, so a
    row with an id stays whenever there is one.
    """

    def __init__(self, spark, keep: str = "min", fan_in: int = 4, memtables: int = 8):
        if keep not in ("min", "max"):
            raise ValueError("keep must be 'min' or 'max'")
        if fan_in < 2 or memtables < 1:
            raise ValueError("fan_in must be 2 or more and memtables 1 or more")
        self.spark, self.keep, self.fan_in, self.memtables = spark, keep, fan_in, memtables
        self.levels: dict[int, list[str]] = {}

    def flush(self, rows: DataFrame, id_col: str) -> None:
        """Adds rows (``id_col``, ``digest``): one sorted level-0 run a memtable.

        All rows of an id go to the same memtable, so an id's row count is whole
        in its run. Rows are aggregated before the shuffle. For ``keep="min"`` the
        ids are held negated, so that compaction takes the maximum either way.
        """
        rank = (F.col(id_col) if self.keep == "max" else -F.col(id_col)).cast("long")
        counted = rows.groupBy(F.pmod(F.xxhash64(F.col(id_col)), F.lit(self.memtables)).alias("run"), "digest", rank.alias("rank")).agg(F.count(F.lit(1)).alias("rows"))
        table = counted.groupBy("run", "digest").agg(F.max(F.struct(F.col("rank").alias("rank"), F.col("rows").alias("best_rows"))).alias("best"), F.sum("rows").alias("rows"))
        self._write(table, 0, self.memtables)
        self.compact()

    def _write(self, table: DataFrame, level: int, runs: int) -> None:
        path = new_path(self.spark, f"lsm-l{level}")
        filters = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}  # sized by what each file holds
        table.sortWithinPartitions("run", "digest").write.partitionBy("run").options(**filters).parquet(path)
        self.levels.setdefault(level, []).extend(f"{path}/run={k}" for k in range(runs))

    def _read(self, paths: list[str]) -> DataFrame:
        base = sorted({p.rsplit("/run=", 1)[0] for p in paths})
        parts = [self.spark.read.schema("digest binary, best struct<rank: long, best_rows: long>, rows long, run int").parquet(b) for b in base]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compact(self) -> None:
        """Merges full levels upward until each level has fewer than ``fan_in`` runs."""
        level = 0
        while level in self.levels:
            paths = self.levels[level]
            if len(paths) >= self.fan_in:
                runs = max(1, len(paths) // self.fan_in)
                merged = self._read(paths).groupBy((F.col("run") % runs).alias("run"), "digest").agg(F.max("best").alias("best"), F.sum("rows").alias("rows"))
                self.levels[level] = []
                self._write(merged, level + 1, runs)
            level += 1

    def table(self) -> DataFrame:
        """digest, keep_id, keep_rows (rows with that id), group_size over all runs."""
        paths = [p for level in self.levels.values() for p in level]
        merged = self._read(paths).groupBy("digest").agg(F.max("best").alias("best"), F.sum("rows").alias("group_size"))
        rank = F.col("best.rank")
        return merged.select("digest", (rank if self.keep == "max" else -rank).alias("keep_id"), F.col("best.best_rows").alias("keep_rows"), "group_size")

    def lookup(self, digests: Sequence[bytes]) -> DataFrame:
        """The entries of ``table()`` for a few digests.

        The digests reach the scans as a predicate, so row groups whose statistics or
        Bloom filter rule them out are not read.
        """
        return self.table().filter(F.col("digest").isin(*map(bytearray, digests)))

    def copies(self) -> DataFrame:
        """The entries of ``table()`` that more than one row has."""
        return self.table().filter("group_size > 1")


class BlockFilter(NamedTuple):
    """A blocked Bloom filter as rows (block, mask); without blocks it lets all through."""

    table: DataFrame | None
    blocks: int


def block_filter(entries: DataFrame, bits: int = 12, most: int = MOST_BLOCKS) -> BlockFilter:
    """A filter of the digests of a written table, of about ``bits`` bits a digest.

    It is broadcast, so it has at most ``most`` blocks: beyond that (some ten million
    digests) there is none, and rows are joined with the table itself.
    """
    need = -(-entries.count() * bits // 64)
    blocks = 1 << max(10, (need - 1).bit_length())
    if blocks > most:
        return BlockFilter(None, 0)
    return BlockFilter(entries.groupBy(_block(F.col("digest"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("digest"))).alias("mask")), blocks)


def passing(rows: DataFrame, filt: BlockFilter, passing: bool) -> DataFrame:
    """The rows whose digest may be in the filter, or those whose digest is not."""
    if filt.table is None:
        return rows if passing else rows.filter(F.lit(False))
    cols = rows.columns
    masks = filt.table.select(F.col("block").alias("_block"), F.col("mask").alias("_mask"))
    joined = rows.withColumn("_block", _block(F.col("digest"), filt.blocks)).join(F.broadcast(masks), "_block", "left")
    held = F.coalesce(F.col("_mask").bitwiseAND(_bits(F.col("digest"))) == _bits(F.col("digest")), F.lit(False))
    return joined.filter(held if passing else ~held).select(*cols)


def _verified(docs: DataFrame, copies: DataFrame, filt: BlockFilter, id_col: str, text_col: str, salt_rows: int) -> DataFrame:
    """Digests of which some row's text differs from that of the row that stays."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", digest_of(F.col("text")))
    hits = passing(rows, filt, True)
    salts = (F.col("group_size") / salt_rows).cast("int")
    stay = (
        hits.join(copies, "digest").filter(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("digest").agg(F.first("text").alias("stay_text"), F.max("group_size").alias("group_size"))
        .select("digest", "stay_text", F.explode(F.sequence(F.lit(0), salts)).alias("salt"))
    )
    size = copies.select("digest", salts.alias("salts"))
    salted = hits.join(size, "digest").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts") + 1).cast("int"))
    return salted.join(stay, ["digest", "salt"]).filter(F.col("text") != F.col("stay_text")).select("digest").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", memtables: int = 8, fan_in: int = 4, salt_rows: int = 1000) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are equal. The row with the
    smallest (``keep="min"``) or largest id stays; a null id stays only if its
    whole group has none. Of repeated rows with that id exactly one is kept. An
    empty table gives an empty result. Other columns of ``docs`` play no part.
    ``id_col`` must be of an integral type.
    """
    out, _, _ = _dedup(docs, id_col, text_col, keep, memtables, fan_in, salt_rows)
    return out


def _dedup(docs, id_col, text_col, keep, memtables, fan_in, salt_rows):
    integral(docs, id_col)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest"))
    index = DigestIndex(spark, keep, fan_in, memtables)
    index.flush(rows, "id")
    copies = written(index.copies(), "lsm-copies")
    filt = block_filter(copies)
    differ = written(_verified(docs, copies, filt, id_col, text_col, salt_rows), "lsm-differ")
    sha = F.lower(F.hex("digest"))
    if not differ.isEmpty():
        raise ValueError("two different texts have one SHA-256 digest")
    joined = rows.join(copies, "digest", "left")
    group = F.coalesce(F.col("group_size"), F.lit(1).cast("long"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    stays = F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))
    plain = joined.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), group.alias("group_size"), stays.alias("kept"), sha.alias("text_sha256"), F.coalesce("keep_rows", F.lit(1)).alias("_rows"))
    if copies.filter("keep_rows > 1").isEmpty():
        return plain.drop("_rows"), copies, filt
    again = F.col("kept") & (F.col("_rows") > 1)
    # rows repeated with the id that stays are alike here: count them and keep one
    counted = plain.filter(again).groupBy(id_col, "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    repeated = counted.select(id_col, "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"), "text_sha256")
    repeated = repeated.select(id_col, "keep_id", "group_size", (F.col("i") == 1).alias("kept"), "text_sha256")
    return plain.filter(~again).drop("_rows").unionByName(repeated), copies, filt


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", memtables: int = 8, fan_in: int = 4, salt_rows: int = 1000) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that the block filter rules out pass without a shuffle; only rows that
    may have copies are joined with the index.
    """
    _, copies, filt = _dedup(docs, id_col, text_col, keep, memtables, fan_in, salt_rows)
    names = docs.columns
    tagged = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)], digest_of(F.col(text_col)).alias("digest"))
    at = f"c_{names.index(id_col)}"
    single = passing(tagged, filt, False)
    joined = passing(tagged, filt, True).join(copies, "digest", "left")
    once = F.col("group_size").isNull() | (F.col(at).eqNullSafe(F.col("keep_id")) & (F.col("keep_rows") == 1))
    parts = [single, joined.filter(once).select(*tagged.columns)]
    if not copies.filter("keep_rows > 1").isEmpty():
        parts.append(joined.filter((F.col("keep_rows") > 1) & F.col(at).eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"]).select(*tagged.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)])
