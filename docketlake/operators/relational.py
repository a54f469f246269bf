"""Lookups, nested results, counts and latest rows over the matter tables.

Many-to-one lookups are left joins whose other side AQE broadcasts when it is small;
one-to-many results are arrays of structs, empty rather than null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketlake.functions.text import last_segment
from docketlake.schema import DOMAINS
from docketlake.sources.folders import written


def lookup(rows: DataFrame, other: DataFrame, on: str, as_: str, columns: Sequence[str], key: str = "id") -> DataFrame:
    """``rows`` with a struct of the other table's columns; null where nothing matches."""
    side = other.select(F.col(key).alias("_key"), F.struct(*columns).alias(as_))
    return rows.join(side, F.col(on) == F.col("_key"), "left").drop("_key")


def nested(rows: DataFrame, children: DataFrame, on: str, as_: str, columns: Sequence[str], order: Sequence[str], key: str = "id") -> DataFrame:
    """``rows`` with an ordered array of child structs; no children: an empty array."""
    item = F.struct(*columns)
    sort = F.struct(*[F.col(c) for c in order])
    lists = children.groupBy(F.col(on).alias("_key")).agg(F.transform(F.sort_array(F.collect_list(F.struct(sort.alias("o"), item.alias("v")))), lambda x: x["v"]).alias(as_))
    joined = rows.join(lists, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumn(as_, F.coalesce(as_, F.array().cast(lists.schema[as_].dataType)))


def one(rows: DataFrame):
    """The only row; an error unless there is exactly one."""
    got = rows.limit(2).collect()
    if len(got) != 1:
        raise LookupError(f"expected one row, found {'none' if not got else 'several'}")
    return got[0]


def one_or_none(rows: DataFrame):
    got = rows.limit(2).collect()
    if len(got) > 1:
        raise LookupError("expected at most one row, found several")
    return got[0] if got else None


def optional_filter(rows: DataFrame, **values) -> DataFrame:
    """Equality filters; those given as None are left out."""
    for name, v in values.items():
        if v is not None:
            rows = rows.filter(F.col(name) == v)
    return rows


def conditional_counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row with a count of each condition and of all rows."""
    return rows.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()], F.count(F.lit(1)).alias("total"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def positions(rows: DataFrame, keys: Sequence[Column], as_: str = "position", rows_per_range: int = 200_000) -> DataFrame:
    """All rows with their position from 1 in the ascending order of ``keys``.

    Nulls come first; for nulls last, put ``isNull()`` before the key, and for a falling
    number its negative. ``rows`` is computed once and written. Its rows are then dealt
    to ranges of the keys, about ``rows_per_range`` each, sorted there and written with
    their number in the range; the counts of the ranges before are added. So a task
    meets one range, and the driver one count a range. Rows with equal keys are in
    arbitrary order, so keys should tell rows apart.
    """
    named = {f"_key{n}": c for n, c in enumerate(keys)}
    held = written(rows.withColumns(named), "unsorted")
    ranges = max(1, -(-held.count() // rows_per_range))
    # the number of the task in the high bits, the place in the sorted task in the low 33
    place = F.monotonically_increasing_id()
    dealt = written(held.repartitionByRange(ranges, *named).sortWithinPartitions(*named).drop(*named).withColumn("_place", place), "sorted")
    low = (1 << 33) - 1
    counts = dealt.groupBy(F.shiftright("_place", 33).alias("_range")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, at = [], 0
    for r in sorted(counts, key=lambda r: r["_range"]):
        offsets.append((r["_range"], at))
        at += r["n"]
    before = rows.sparkSession.createDataFrame(offsets, "_range long, _before long")
    out = dealt.withColumn("_range", F.shiftright("_place", 33)).join(F.broadcast(before), "_range")
    return out.withColumn(as_, F.col("_before") + F.col("_place").bitwiseAND(F.lit(low)) + 1).select(*rows.columns, as_)


def next_number(parents: DataFrame, children: DataFrame, on: str, key: str = "id") -> DataFrame:
    """id, next_version: one more than the number of children (not the largest number)."""
    n = children.groupBy(F.col(on).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    return parents.join(n, F.col(key) == F.col("_key"), "left").select(key, (F.coalesce("n", F.lit(0)) + 1).alias("next_version"))


def grouped_lists(rows: DataFrame, by: Column, name: str, item: Column, order: Sequence[Column], as_: str = "items") -> DataFrame:
    """Rows gathered under a label, in order; the label of null keys is up to ``by``."""
    held = F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], item.alias("v"))))
    return rows.groupBy(by.alias(name)).agg(F.transform(held, lambda x: x["v"]).alias(as_), F.count(F.lit(1)).alias("n"))


def grouped_pages(rows: DataFrame, by: Column, name: str, item: Column, order: Sequence[Column], as_: str = "items", size: int = 1000) -> DataFrame:
    """``grouped_lists`` in pages: label, page (from 0), its items in order, and n of the whole group.

    A row holds ``size`` items at most, whatever the group. Places within a group come
    from the positions of all rows by label and order, so a group with most of the rows
    is in many tasks. A null label is a group.
    """
    named = {f"_o{n}": c for n, c in enumerate(order)}
    held = rows.select(by.alias(name), item.alias("_item"), *[c.alias(k) for k, c in named.items()])
    placed = positions(held, [F.col(name), *map(F.col, named)], "_at")
    groups = placed.groupBy(name).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n")).withColumnRenamed(name, "_label")
    joined = placed.join(groups, F.col(name).eqNullSafe(F.col("_label")))
    paged = joined.withColumn("_within", F.col("_at") - F.col("_first")).withColumn("page", F.floor(F.col("_within") / size).cast("long"))
    lists = paged.groupBy(name, "page").agg(F.array_sort(F.collect_list(F.struct("_within", "_item"))).alias("_held"), F.first("n").alias("n"))
    return lists.select(name, "page", F.transform("_held", lambda x: x["_item"]).alias(as_), "n")


def precedent_sources(chunks: DataFrame, types: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """One row per source path of the precedent chunks, as the newest chunk tells it.

    Rows without a path (null or empty) are left out. The file name is that of the
    metadata, else the path's last segment, else the path. ``chunks`` needs
    storage_path, filename, document_type_id, created_at and is_precedent.
    """
    held = chunks.filter(F.col("is_precedent") & F.col("storage_path").isNotNull() & (F.col("storage_path") != ""))
    # the first row by created_at descending, then by the given columns ascending
    newest = F.max_by(F.struct("filename", "document_type_id", "created_at"), F.struct("created_at", *[-F.col(c) for c in order]))
    out = held.groupBy("storage_path").agg(newest.alias("first"), F.count(F.lit(1)).alias("chunk_count"))
    out = out.select("storage_path", F.coalesce("first.filename", last_segment(F.col("storage_path")), "storage_path").alias("filename"), F.col("first.document_type_id").alias("document_type_id"), "chunk_count", F.col("first.created_at").alias("created_at"))
    return out.join(types.select(F.col("id").alias("document_type_id"), F.col("name").alias("document_type_name")), "document_type_id", "left")


def profiles_with_role(profiles: DataFrame, roles: DataFrame) -> DataFrame:
    """Profiles with one role each: the highest of those held, null without any."""
    rank = F.array_position(F.array(*map(F.lit, DOMAINS["user_roles", "role"])), F.col("role"))
    top = roles.groupBy("user_id").agg(F.min_by("role", rank).alias("role"))
    return profiles.join(top.withColumnRenamed("user_id", "id"), "id", "left")


def semi(rows: DataFrame, other: DataFrame, on: str, key: str) -> DataFrame:
    """Rows for which a row of the other side exists."""
    return rows.join(other.select(F.col(key).alias("_key")), F.col(on) == F.col("_key"), "left_semi")
