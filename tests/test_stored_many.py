"""Uploads of many objects: what reaches the driver does not grow with them, and late tasks leave nothing."""

import os
import pickle
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql.types import StructType

from docketlake.sources import stored_files as O

SCHEMA = StructType().add("path", "string").add("content", "binary")


def batch(n):
    return pa.RecordBatch.from_arrays([pa.array([f"d{k % 7}/{k}.txt" for k in range(n)]), pa.array([b"x"] * n)], names=["path", "content"])


def test_messages_of_a_task_have_one_size():
    sizes = set()
    for n in (1, 2000):
        root = tempfile.mkdtemp(prefix="stored-")
        w = O.FilesWriter({"path": root}, SCHEMA)
        message = w.write(iter([batch(n)]))
        sizes.add(len(pickle.dumps(message)) - len(root))
        w.commit([message])
        assert sum(len(f) for _, _, f in os.walk(root)) == n and not [x for x in os.listdir(root) if x.startswith(".")]
    assert len(sizes) == 1


def test_a_late_task_leaves_nothing():
    root = tempfile.mkdtemp(prefix="stored-")
    w = O.FilesWriter({"path": root}, SCHEMA)
    w.abort([])
    with pytest.raises(OSError):
        w.write(iter([batch(3)]))
    assert os.listdir(root) == []


def test_many_objects_are_moved_once(spark):
    root = tempfile.mkdtemp(prefix="stored-")
    rows = spark.range(3000).selectExpr("concat('a', id % 5, '/', id, '.txt') AS path", "cast(string(id) AS binary) AS content").repartition(6)
    O.upload(rows, root)
    O.upload(rows, root)
    got = {r.path: bytes(r.content) for r in O.stored_files(spark, root).collect()}
    assert got == {f"a{k % 5}/{k}.txt": str(k).encode() for k in range(3000)} and sorted(os.listdir(root)) == [f"a{k}" for k in range(5)]
    O.upload(rows.limit(0), root)
    assert len(os.listdir(root)) == 5
