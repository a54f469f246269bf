"""A queue of files with state: attempts, the last error and the time of the next try, by path.

A file that arrives is tried at once. If the work fails it is tried again when its
timer fires, after a wait that doubles, until it is done or has failed ``most`` times.
The state is the stream's: it survives a restart from the checkpoint, a done file is
never tried again, and a new version of a file starts over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketlake.functions.text import extension
from docketlake.sources.embed import Embedder
from docketlake.sources.extract import EXTRACTORS, Extractor, unsupported
from docketlake.streaming.ingest import ingest_text

#: (columns of the result) of a path; an exception is a failed attempt
Work = Callable[[str], dict]

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "path string, version string, attempt int, outcome string, error string"


class Attempts(StatefulProcessor):
    """Tries the work of one path; rows tell each attempt: done, retry or failed."""

    def __init__(self, work: Work, columns: list[str], most: int, wait_ms: int):
        self.work, self.columns, self.most, self.wait_ms = work, columns, most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "version string, attempts int, finished boolean, error string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(str(v) for part in rows for v in part["version"])
        held = self.state.get() if self.state.exists() else None
        if held is not None and newest <= held[0]:
            return  # known: done, given up or waiting for its timer
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        yield self._try(key[0], newest, 0, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        version, attempts, finished, _ = self.state.get()
        if not finished:
            yield self._try(key[0], version, attempts, timerValues)

    def _try(self, path: str, version: str, before: int, timers) -> pd.DataFrame:
        attempt, result, error = before + 1, {}, None
        try:
            result = self.work(path)
        except Exception as e:  # told in the row
            error = str(e) or type(e).__name__
        outcome = "done" if error is None else "retry" if attempt < self.most else "failed"
        self.state.update((version, attempt, outcome != "retry", error))
        if outcome == "retry":
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.wait_ms * 2**before)
        row = {"path": path, "version": version, "attempt": attempt, "outcome": outcome, "error": error}
        return pd.DataFrame([row | {c: result.get(c) for c in self.columns}]).astype({c: "Int64" for c in self.columns if c.endswith("_count")})

    def close(self) -> None:
        pass


def attempts(arriving: DataFrame, work: Work, result: str = "", most: int = 3, wait_ms: int = 60_000) -> DataFrame:
    """A row an attempt of a stream of (path, version): path, version, attempt, outcome, error and ``result`` columns.

    Versions compare as texts; a path's rows of one batch count as its newest.
    """
    if most < 1:
        raise ValueError("most must be positive")
    arriving.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    columns = [c.strip().split(" ")[0] for c in result.split(",")] if result else []
    schema = f"{OUTCOME}, {result}" if result else OUTCOME
    keyed = arriving.select("path", F.col("version").cast("string").alias("version")).groupBy("path")
    return keyed.transformWithStateInPandas(Attempts(work, columns, most, wait_ms), schema, "Append", "processingTime")


TEXT = "filename string, file_type string, file_size long, text string, original_format string, page_count int, sheet_count int"


class FileText:
    """The work of ingestion: reads a file and extracts its text."""

    def __init__(self, extractors: dict[str, Extractor] | None = None):
        self.extractors = EXTRACTORS | (extractors or {})

    def __call__(self, path: str) -> dict:
        from pyarrow import fs as pafs

        at, name = pafs.FileSystem.from_uri(path)
        with at.open_input_stream(name) as f:
            data = f.read()
        file = name.rsplit("/", 1)[-1]
        kind = file.rsplit(".", 1)[-1].lower()
        text, meta = self.extractors.get(kind, unsupported(kind))(data)
        if not text.strip():
            raise ValueError("No text content could be extracted from the document")
        return {"filename": file, "file_type": kind, "file_size": len(data), "text": text, **meta}


def ingest_queue(spark: SparkSession, path: str, out: str, checkpoint: str, embedder: Embedder, bucket: str, most: int = 3, wait_ms: int = 60_000, extractors: dict[str, Extractor] | None = None, trigger: dict | None = None, **options):
    """Ingests files under ``path`` with retries: chunks and a report of attempts under ``out``.

    Each batch writes a partition of its own, so a batch that is tried again replaces what it left.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    arriving = files.select("path", F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("version"))
    tried = attempts(arriving, FileText(extractors), TEXT, most, wait_ms)

    def each(batch: DataFrame, number: int) -> None:
        held = f"{out}/attempts/batch={number}"
        batch.write.mode("overwrite").parquet(held)  # the state moves once a batch: its rows are kept before they are used
        rows = spark.read.parquet(held).withColumn("file_type", extension(F.col("path")))
        chunks, _ = ingest_text(rows.filter("outcome = 'done'"), embedder, bucket, **options)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")

    writer = tried.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
