"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs on one machine (tests) a temporary
    local folder is made once and reused; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='docketlake-')}")
    return _LOCAL[0]


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/docketlake/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs only the tasks that were running.
    """
    path = new_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, not when the driver happens to collect its garbage.

    For chains of ``written`` tables: what is read again is there as Parquet.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def clear_written(spark: SparkSession) -> None:
    """Deletes the tables that ``written`` has left for this application; others' stay.

    Call it once the results that read them are written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Gives memory that this worker has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of ``mapInArrow``, after which the worker keeps no freed memory.

    Workers serve one stage after another, so what one has freed would count beside the next.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return over


def small_batches(spark: SparkSession, size: str = "2m") -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to ``size``.

    Batches of long texts are held outside the heap and in the Python worker at once,
    for every core. Results are the same at any limit.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def integral(df: DataFrame, *columns: str) -> None:
    """An error unless the columns are of integral types."""
    for c in columns:
        if (kind := df.schema[c].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint"):
            raise TypeError(f"{c} must be of an integral type, not {kind}")


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string")) % n


def in_fold(id_col: str | Column, n: int, k: int) -> Column:
    """Whether ``fold`` is ``k``; a null id is in no fold."""
    return F.coalesce(fold(id_col, n) == k, F.lit(False))


def text_slices(batch: pa.RecordBatch, column: str, chars: int = 2_000_000, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of slices of a batch, each of bounded rows and size.

    Null texts come as empty ones. A slice holds at least one text, so only a
    single text longer than ``chars`` makes a slice larger.
    """
    col = batch.column(column)
    at, n = 0, len(col)
    while at < n:
        texts: list[str] = []
        size = 0
        for x in col.slice(at, rows).to_pylist():
            x = x or ""
            if texts and size + len(x) > chars:
                break
            texts.append(x)
            size += len(x)
        yield at, texts
        at += len(texts)
