"""Results that follow changes: counts and latest rows kept up to date without a full pass.

A change row is a row with the weight +1 (it came) or -1 (it went); an update is both.
Counts add weighted sums to what is held. Latest rows compare what came with what is
held; only where a held row went are the rows of its key read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.operators.relational import latest

WEIGHT = "_weight"


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The change rows between two snapshots of a table; equal rows count as often as they occur."""
    went = before.exceptAll(after).withColumn(WEIGHT, F.lit(-1))
    came = after.exceptAll(before).withColumn(WEIGHT, F.lit(1))
    return went.unionByName(came)


def counts(rows: DataFrame, keys: Sequence[str], **conditions: Column) -> DataFrame:
    """keys, a count of each condition and ``total`` of all rows, a row a key."""
    return _sums(rows.withColumn(WEIGHT, F.lit(1)), keys, conditions)


def _sums(weighted: DataFrame, keys: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    held = [F.sum(F.when(c, F.col(WEIGHT)).otherwise(0)).alias(k) for k, c in conditions.items()]
    return weighted.groupBy(*keys).agg(*held, F.sum(WEIGHT).alias("total"))


def updated_counts(held: DataFrame, changed: DataFrame, keys: Sequence[str], **conditions: Column) -> DataFrame:
    """``counts`` after the changes; a key whose last row went is gone.

    ``held`` has as many rows as there are keys, ``changed`` as many as there are
    changes: the table itself is not read.
    """
    both = held.unionByName(_sums(changed, keys, conditions))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in held.columns if c not in keys]).filter("total > 0")


def updated_latest(held: DataFrame, changed: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``latest`` of each key after the changes; ``rows`` is the table after them.

    ``order`` has to tell a key's rows apart. The table is read only where held rows
    went, and then for their keys alone.
    """
    columns = held.columns
    went, came = changed.filter(F.col(WEIGHT) < 0).select(*columns), changed.filter(F.col(WEIGHT) > 0).select(*columns)
    lost = held.intersect(went).select(*keys).distinct()
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    stay = held.alias("h").join(lost.alias("l"), condition, "left_anti").unionByName(came)
    if not lost.isEmpty():
        stay = stay.unionByName(rows.select(*columns).alias("h").join(lost.alias("l"), condition, "left_semi"))
    return latest(stay, keys, order)
