"""The stored-files source: partitions by bytes, filters on the listing, streams, writes that are whole or nothing."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from docketlake.sources import stored_files as O


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="stored-")


def put(root, path, data=b"x", at=None):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(data)
    if at:
        os.utime(full, (at, at))


def names(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files)


def test_contents_and_types(spark, root):
    for path, data in (("a/One.DOCX", b"12345"), ("b.txt", b""), ("c/d/noext", b"\0\xff"), (".hidden/x.txt", b"no"), ("_temporary/y.txt", b"no")):
        put(root, path, data)
    got = {r.path: (bytes(r.content), r.length, r.file_type, r.error) for r in O.stored_files(spark, root).collect()}
    assert got == {"a/One.DOCX": (b"12345", 5, "docx", None), "b.txt": (b"", 0, "txt", None), "c/d/noext": (b"\0\xff", 2, "noext", None)}
    changed = O.stored_files(spark, root).filter("path = 'b.txt'").first().modificationTime
    assert abs(changed.timestamp() - os.path.getmtime(os.path.join(root, "b.txt"))) < 1


def test_partitions_follow_the_bytes():
    files = [O.Stored(f"f{k}", s, 0) for k, s in enumerate([10, 10, 200 << 20, 10, 40 << 20, 40 << 20])]
    parts = [[f.path for f in p.files] for p in O.packed(files, 64 << 20)]
    assert parts == [["f0", "f1"], ["f2"], ["f3", "f4"], ["f5"]]
    many = O.packed([O.Stored(str(k), 1000, 0) for k in range(1000)], 64 << 20)
    assert 10 < len(many) < 20


def test_filters_open_no_other_file(spark, root):
    put(root, "a.docx", b"123")
    put(root, "b.txt", b"1")
    os.chmod(os.path.join(root, "b.txt"), 0)
    kept = O.stored_files(spark, root).filter("file_type IN ('docx', 'xlsx') AND length > 2 AND path <> 'z'")
    assert [r.path for r in kept.collect()] == ["a.docx"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "file_type" not in [line for line in plan.splitlines() if line.strip(" +-*()1").startswith("Filter")][0]
    assert O.stored_files(spark, root).filter("length < 0").count() == 0


def test_a_large_file_is_an_error_row(spark, root):
    put(root, "big.docx", b"1234567")
    with open(os.path.join(root, "huge.docx"), "wb") as f:
        f.truncate((2 << 30) + 10)  # sparse
    got = {r.path: (r.content, r.error) for r in O.stored_files(spark, root).collect()}
    assert got["huge.docx"] == (None, f"File too large: {(2 << 30) + 10} bytes") and got["big.docx"][1] is None
    assert O.stored_files(spark, root, most_bytes=6).filter("error IS NOT NULL").count() == 2


def test_no_folder_gives_no_rows(spark, root):
    assert O.stored_files(spark, os.path.join(root, "none")).count() == 0


def objects(spark, rows):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None, 1) for p, c in rows], "path string, content binary, other int")


def test_upload_and_again(spark, root):
    rows = objects(spark, [("m/1/v1-a.docx", b"one"), ("m/2/v1-b.docx", None), ("top.txt", b"x" * 100_000)]).repartition(3)
    O.upload(rows, root)
    assert names(root) == ["m/1/v1-a.docx", "m/2/v1-b.docx", "top.txt"]
    before = os.stat(os.path.join(root, "top.txt")).st_mtime_ns
    O.upload(rows, root)  # the same bytes: nothing changes
    assert os.stat(os.path.join(root, "top.txt")).st_mtime_ns == before and len(names(root)) == 3
    with pytest.raises(Exception, match="already exists"):
        O.upload(objects(spark, [("new.txt", b"n"), ("top.txt", b"other")]), root)
    assert len(names(root)) == 3 and not os.path.exists(os.path.join(root, "new.txt"))
    O.upload(objects(spark, [("top.txt", b"other")]), root, upsert=True)
    assert open(os.path.join(root, "top.txt"), "rb").read() == b"other" and sorted(os.listdir(root)) == ["m", "top.txt"]


@pytest.mark.parametrize("bad", ["../out.txt", "/etc/x", "", None, "a/../../b", ".staging-x/y"])
def test_a_failed_task_leaves_no_object(spark, root, bad):
    with pytest.raises(Exception, match="not a path"):
        O.upload(objects(spark, [("fine.txt", b"1"), (bad, b"2")]).repartition(2), root)
    assert names(root) == [] and os.listdir(root) == []


def test_a_path_twice_is_refused(spark, root):
    with pytest.raises(Exception, match="twice"):
        O.upload(objects(spark, [("a.txt", b"1"), ("a.txt", b"2")]), root)
    assert names(root) == []


def test_remove_with_chunks(spark, root):
    for p in ("a.docx", "b.docx"):
        put(root, p)
    chunks = spark.createDataFrame([(1, '{"storage_path": "a.docx"}'), (2, '{"storage_path": "b.docx"}'), (3, "{}"), (4, None)], "id int, metadata string")
    wanted = spark.createDataFrame([("a.docx",), ("a.docx",), ("gone.docx",)], "path string")
    left, removed = O.remove_with_chunks(root, chunks, wanted)
    assert sorted(r.id for r in left.collect()) == [2, 3, 4]
    assert sorted(map(tuple, removed.collect())) == [("a.docx", True), ("gone.docx", False)]
    assert names(root) == ["b.docx"]


def test_stream_takes_each_file_once(spark, root):
    O.register(spark)
    past = time.time() - 100
    put(root, "a.txt", b"1", past)
    put(root, "b.txt", b"22", past + 1)
    work = tempfile.mkdtemp(prefix="stored-stream-")

    def run():
        q = spark.readStream.format("stored_files").load(root).select("path", F.length("content").alias("n")).writeStream.format("parquet").option("checkpointLocation", f"{work}/cp").option("path", f"{work}/out").trigger(processingTime="200 milliseconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.read.parquet(f"{work}/out").collect()))

    assert run() == [("a.txt", 1), ("b.txt", 2)]
    put(root, "c.txt", b"333", past + 5)
    put(root, "soon.txt", b"4", time.time() + 1000)  # not settled yet
    assert run() == [("a.txt", 1), ("b.txt", 2), ("c.txt", 3)]
    assert run() == [("a.txt", 1), ("b.txt", 2), ("c.txt", 3)]
