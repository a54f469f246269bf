"""A snapshot store: one folder a table, one Parquet snapshot a change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.schema import DOMAINS, TABLES, UNIQUE


class SnapshotStore:
    """Tables under ``path``; a change writes a new snapshot and then names it current.

    The names of snapshots are kept in a small Parquet table beside them, one partition a
    version, so all reads and writes go through Spark's file systems. A version is named
    once: of two writers that start from one version the second fails, and has to read
    and write again. A change rewrites its table; what arrives in bulk is appended by
    the ingestion instead.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self, table: str) -> DataFrame:
        try:
            return self.spark.read.schema("folder string, version long").parquet(f"{self.path}/{table}/_versions")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "folder string, version long")

    def _current(self, table: str) -> tuple[int, str | None]:
        best = self._log(table).agg(F.max(F.struct("version", "folder"))).first()[0]
        return (best["version"], best["folder"]) if best else (0, None)

    def version(self, table: str) -> int:
        return self._current(table)[0]

    def read(self, table: str) -> DataFrame:
        """The current snapshot, by the table's own schema; none yet: no rows."""
        _, folder = self._current(table)
        if folder is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}/{folder}")

    def write(self, table: str, rows: DataFrame, partition_by: str | None = None, after: int | None = None) -> DataFrame:
        """Checks the rows, writes them as the next snapshot and returns it.

        ``after`` is the version that ``rows`` were made from, the current one unless given.
        """
        rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])
        v = 1 + (self.version(table) if after is None else after)
        folder = f"v{v}-{uuid.uuid4().hex}"  # a snapshot that fails its checks is never named current
        out = f"{self.path}/{table}/{folder}"
        writer = rows.write.partitionBy(partition_by) if partition_by else rows.write
        writer.parquet(out)
        if faults := self.faults(table, self.spark.read.schema(rows.schema).parquet(out)):
            raise ValueError(f"{table}: {'; '.join(faults)}")
        self.spark.range(1).select(F.lit(folder).alias("folder")).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/{table}/_versions/version={v}")
        return self.read(table)

    def faults(self, table: str, rows: DataFrame) -> list[str]:
        """Nulls in required columns, values out of their domain, keys that repeat."""
        need = [f.name for f in TABLES[table].fields if not f.nullable]
        held = {c: d for (t, c), d in DOMAINS.items() if t == table}
        checks = [F.count_if(F.col(c).isNull()).alias(f"{c} is null") for c in need] + [F.count_if(~F.col(c).isin(*d)).alias(f"{c} is out of its domain") for c, d in held.items()]
        found = [k for k, n in rows.agg(*checks).first().asDict().items() if n]
        for keys in (("id",), *([UNIQUE[table]] if table in UNIQUE else [])):
            if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
                found.append(f"{', '.join(keys)} repeat")
        return found
