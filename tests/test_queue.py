"""The queue of files: tries over batches, never again once done, state over a restart."""

import os
import tempfile
import time

import pytest

from docketlake.sources.embed import HashingEmbedder
from docketlake.streaming import queue as K


class Flaky:
    """Fails a path's first tries, as many as its name ends with; counts tries in files."""

    def __init__(self, at):
        self.at = at

    def __call__(self, path):
        mark = os.path.join(self.at, path.replace("/", "_"))
        with open(mark, "a") as f:
            f.write("x")
        tries = os.path.getsize(mark)
        if tries <= int(path.rsplit("-", 1)[1]):
            raise OSError(f"try {tries} of {path}")
        return {"size": len(path)}


def tries(at):
    return {f: os.path.getsize(os.path.join(at, f)) for f in sorted(os.listdir(at))}


@pytest.fixture
def place():
    root = tempfile.mkdtemp(prefix="queue-")
    for d in ("in", "marks"):
        os.makedirs(f"{root}/{d}")
    return root


def arrive(spark, place, *rows):
    spark.createDataFrame(rows, "path string, version string").coalesce(1).write.mode("append").parquet(f"{place}/in")


def started(spark, place, wait_ms=300):
    arriving = spark.readStream.schema("path string, version string").parquet(f"{place}/in")
    out = K.attempts(arriving, Flaky(f"{place}/marks"), "size int", most=3, wait_ms=wait_ms)
    return out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/cp").start()


def until(spark, q, place, n, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        assert q.exception() is None
        if os.path.isdir(f"{place}/out"):
            rows = sorted((r.path, r.attempt, r.outcome, r.size) for r in spark.read.schema(f"{K.OUTCOME}, size int").parquet(f"{place}/out").collect())
            if len(rows) >= n:
                return rows
        time.sleep(0.3)
    raise AssertionError(f"{n} attempts did not happen")


def test_tries_over_batches_and_a_restart(spark, place):
    arrive(spark, place, ("a-0", "1"), ("b-1", "1"), ("c-9", "1"), ("c-9", "0"))
    q = started(spark, place)
    rows = until(spark, q, place, 6)
    assert rows == [("a-0", 1, "done", 3), ("b-1", 1, "retry", None), ("b-1", 2, "done", 3), ("c-9", 1, "retry", None), ("c-9", 2, "retry", None), ("c-9", 3, "failed", None)]
    arrive(spark, place, ("d-1", "1"), ("a-0", "1"), ("c-9", "1"))
    until(spark, q, place, 7)
    q.stop()  # d-1 may wait for its second try
    q = started(spark, place)
    rows = until(spark, q, place, 8)
    assert rows[-2:] == [("d-1", 1, "retry", None), ("d-1", 2, "done", 3)]
    arrive(spark, place, ("a-0", "2"), ("a-0", "1"))
    assert until(spark, q, place, 9)[:2] == [("a-0", 1, "done", 3)] * 2
    q.stop()
    assert tries(f"{place}/marks") == {"a-0": 2, "b-1": 2, "c-9": 3, "d-1": 2}


def test_ingestion_with_retries(spark, place):
    for name, text in (("ok.txt", "some words here"), ("blank.txt", "  "), ("odd.bin", "x")):
        with open(f"{place}/in/{name}", "w") as f:
            f.write(text)
    q = K.ingest_queue(spark, f"{place}/in", f"{place}/out", f"{place}/cp", HashingEmbedder(8), "b", most=2, wait_ms=200, extractors={"txt": plain}, upload_date="2024-01-01")
    end = time.time() + 60
    rows = []
    while time.time() < end and len(rows) < 5:
        assert q.exception() is None
        time.sleep(0.5)
        if os.path.isdir(f"{place}/out/attempts"):
            rows = sorted((r.path.rsplit("/", 1)[1], r.attempt, r.outcome) for r in spark.read.schema(K.OUTCOME).parquet(f"{place}/out/attempts").collect())
    time.sleep(3)  # the chunks of the last batch
    q.stop()
    assert rows == [("blank.txt", 1, "retry"), ("blank.txt", 2, "failed"), ("odd.bin", 1, "retry"), ("odd.bin", 2, "failed"), ("ok.txt", 1, "done")]
    assert [r.content for r in spark.read.parquet(f"{place}/out/chunks").collect()] == ["some words here"]


def plain(data):
    return data.decode(), {"original_format": "text"}


def test_most_must_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        K.attempts(spark.range(1), plain, most=0)
