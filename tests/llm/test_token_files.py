"""Token files: blocks, files, the data source and the query against the tokenizers library."""

import io
import json
import os
import random
import tempfile
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketlake.llm import token_files as tf
from docketlake.llm.common import new_path
from docketlake.llm.queries import WORD_BPE, queries

from ..conftest import SF
from .test_llm import awkward, docs_of, empty


def sequences():
    r = np.random.default_rng(4)
    yield np.empty(0, np.uint32)
    yield np.array([7], np.uint32)
    for n in (255, 256, 257, 5000):
        yield r.integers(0, 50_000, n).astype(np.uint32)
        yield r.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
        yield np.full(n, 2**32 - 1, np.uint32)
        x = r.integers(40, 44, n).astype(np.uint32)
        x[:: 30] = 2**32 - 1
        x[5::70] = 0
        yield x
    for bits in range(33):
        yield (r.integers(0, 2**32, 600, dtype=np.uint64) >> np.uint64(32 - bits)).astype(np.uint32) if bits else np.zeros(600, np.uint32)


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_blocks_come_back(share):
    for ids in sequences():
        data, sizes = tf.pack_blocks(ids, share)
        assert len(data) == sizes.sum() and len(sizes) == -(-len(ids) // 256)
        if len(ids):
            assert np.array_equal(tf.unpack_blocks(data, np.cumsum(sizes) - sizes)[: len(ids)], ids)


def test_layout_of_a_block():
    ids = np.array([10, 11, 13, 1000] + [10] * 252, np.uint32)
    data, _ = tf.pack_blocks(ids)
    assert data.tobytes() == (10).to_bytes(4, "little") + bytes([0, 0, 3, 0]) + bytes([1, 2, 3]) + b"".join(x.to_bytes(4, "little") for x in (1, 3, 990))
    packed, _ = tf.pack_blocks(np.arange(256, dtype=np.uint32), share=1.0)
    assert packed[4] == 8 and packed[8:].tobytes() == bytes(range(256))


def test_outliers_do_not_widen_a_block():
    ids = np.full(256, 9, np.uint32)
    ids[::32] = 49_000
    assert len(tf.pack_blocks(ids)[0]) == 8 + 8 * 5


def test_file_is_read_by_its_index(monkeypatch):
    monkeypatch.setattr(tf, "HELD", 1024)
    r = random.Random(2)
    docs = [(k if k % 7 else None, array("I", [r.randrange(50_000) for _ in range(r.choice((0, 1, 300, 3000)))]).tobytes()) for k in range(60)]
    out = io.BytesIO()
    writer = tf.TokenFileWriter(out)
    for k in range(0, 60, 9):
        writer.add([d for d, _ in docs[k : k + 9]], [x for _, x in docs[k : k + 9]])
    every = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    assert writer.close() == (len(every), 60)
    file = tf.TokenFile(pa.BufferReader(out.getvalue()))
    for first, n in ((0, len(every)), (0, 1), (255, 2), (1000, 5000), (len(every) - 1, 9), (len(every), 3)):
        assert np.array_equal(file.ids(first, n), every[first : first + n])
    assert np.array_equal(np.concatenate([x for _, _, x in file.documents()]), every)
    with pytest.raises(ValueError, match="cut short"):
        tf.TokenFile(pa.BufferReader(out.getvalue()[:-9]))


def brute(rows, end):
    library = Tokenizer.from_file(WORD_BPE)
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = array("I", [*library.encode(t or "", add_special_tokens=False).ids, end])
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_is_the_library(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries()["op11_token_files"](spark, SF).collect()) == brute(docs, 2)


def folder(spark):
    return new_path(spark, "test-token-files")


def test_awkward_rows(spark):
    path = folder(spark)
    df = awkward(spark)
    tf.write_token_files(df.repartition(3), WORD_BPE, path, least_bytes=50_000)
    got = tf.read_token_files(spark, path).orderBy("start")
    rows = [tuple(r) for r in got.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()]
    assert len(tf._manifest(path)["files"]) > 2
    assert [r[0] for r in rows] == [None, *sorted(r.doc_id for r in df.collect() if r.doc_id is not None)]
    assert rows == brute([(r.doc_id, r.text) for r in df.collect()], 2)
    every = b"".join(r.ids for r in got.collect())
    assert tf.ids_between(path, 7, 90_000).astype("<u4").tobytes() == every[28 : 4 * 90_007]
    assert len(tf.ids_between(path, len(every), 5)) == 0


def test_no_rows(spark):
    path = folder(spark)
    tf.write_token_files(empty(spark), WORD_BPE, path)
    assert tf.read_token_files(spark, path).count() == 0 and tf._manifest(path)["files"] == []


def local(path):
    return path.removeprefix("file://")


def test_a_hot_id_is_cut(spark):
    path = folder(spark)
    tf.write_token_files(docs_of(spark, [(5, f"some words {k % 50}") for k in range(3000)] + [(1, "a"), (9, "b")]).repartition(4), WORD_BPE, path, least_bytes=8000)
    files = tf._manifest(path)["files"]
    assert len(files) > 2 and max(f["docs"] for f in files) < 2500


def test_folder_is_not_written_twice_but_overwritten(spark):
    path = folder(spark)
    tf.write_token_files(docs_of(spark, [(1, "one")]), WORD_BPE, path)
    with pytest.raises(Exception, match="overwrite"):
        tf.write_token_files(docs_of(spark, [(2, "two")]), WORD_BPE, path)
    ids = spark.createDataFrame([(4, bytearray(array("I", [5, 6]).tobytes())), (6, None)], "doc_id long, ids binary").coalesce(1)
    ids.write.format("token_files").mode("overwrite").save(path)
    assert [tuple(r)[:3] for r in tf.read_token_files(spark, path).orderBy("start").collect()] == [(4, 0, 2), (6, 2, 0)]
    assert len([f for f in os.listdir(local(path)) if f.endswith(".pfor")]) == 1


def test_a_failed_job_leaves_nothing(spark):
    path = folder(spark)
    unsorted = spark.createDataFrame([(4, bytearray(b"\0" * 8)), (2, bytearray(b"\0" * 8))], "doc_id long, ids binary").coalesce(1)
    spark.dataSource.register(tf.TokenFiles)
    with pytest.raises(Exception, match="ascending"):
        unsorted.write.format("token_files").mode("append").save(path)
    assert not os.path.exists(local(path)) or os.listdir(local(path)) == []


def test_leftovers_of_lost_tasks_are_cleared():
    path = tempfile.mkdtemp(prefix="token-files-")
    schema = tf.StructType().add("doc_id", "long").add("ids", "binary")
    writer = tf.TokenWriter({"path": path}, schema, False)
    for name in (f"0000000-{writer.job}-a.pfor", f"0000000-{writer.job}-b.pfor", "0000000-other-a.pfor"):
        open(os.path.join(path, name), "wb").close()
    writer.commit([tf.FileWritten(0, f"0000000-{writer.job}-b.pfor", 3, 1, 1, 1), None])
    assert sorted(os.listdir(path)) == sorted([f"0000000-{writer.job}-b.pfor", "0000000-other-a.pfor", tf.MANIFEST])
    with open(os.path.join(path, tf.MANIFEST)) as f:
        assert json.load(f)["files"] == [{"name": f"0000000-{writer.job}-b.pfor", "start": 0, "ids": 3, "docs": 1}]
