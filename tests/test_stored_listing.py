"""Listing of many stored files: in tasks, so what the driver plans with does not grow with them."""

import os
import pickle
import tempfile

import pytest

from docketlake.sources import stored_files as O


@pytest.fixture(scope="module")
def root():
    root = tempfile.mkdtemp(prefix="stored-")
    for k in range(3000):
        folder = f"{root}/d{k % 3}/{'e/' * (k % 4)}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}{k}.txt", "wb") as f:
            f.write(b"%d" % k)
    for hidden in (f"{root}/d0/.h", f"{root}/_h"):
        os.makedirs(hidden)
        open(f"{hidden}/x.txt", "wb").close()
    os.makedirs(f"{root}/empty/é")
    return root


def planned(root, **options):
    return O.FilesReader({"path": root} | {k: str(v) for k, v in options.items()}).partitions()


def test_the_driver_plans_without_names(spark, root):
    few, many = tempfile.mkdtemp(prefix="stored-"), O.listing(spark, root)
    for k in range(700):
        open(f"{few}/{k}.txt", "wb").close()
    sizes = [max(len(pickle.dumps(p)) for p in planned(r, listing=at, most_partitions=10)) for r, at in ((few, O.listing(spark, few)), (root, many))]
    assert len(planned(root, listing=many, most_partitions=10)) == 10 and len(planned(root, most_partitions=10)) <= 10
    assert sizes[0] < 500 and sizes[1] < 1500  # a few spans of packs; 300 names are more
    assert b"2999.txt" not in b"".join(pickle.dumps(p) for p in planned(root, listing=many, most_partitions=10))


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_every_file_is_read_once(spark, root, most):
    df = O.stored_files(spark, root, most_partitions=most)
    assert df.rdd.getNumPartitions() <= most
    got = df.collect()
    want = {f"d{k % 3}/{'e/' * (k % 4)}{k}.txt": str(k).encode() for k in range(3000)}
    assert len(got) == 3000 and {r.path: bytes(r.content) for r in got} == want
    assert all(r.length == len(r.content) and r.error is None for r in got)


def test_the_two_listings_agree(spark, root):
    by = ["path", "modificationTime", "length", "file_type"]
    a, b = O.stored_files(spark, root).select(*by), spark.read.format("stored_files").load(root).select(*by)
    assert sorted(a.collect()) == sorted(b.collect())
    assert O.stored_files(spark, root).filter("length = 1").count() == 10


def test_packs_follow_the_bytes(spark):
    root = tempfile.mkdtemp(prefix="stored-")
    for name, size in (("a", 10), ("b", 10), ("c", 200 << 20), ("d", 10), ("e", 40 << 20), ("f", 40 << 20)):
        with open(f"{root}/{name}", "wb") as f:
            f.truncate(size)  # sparse
    packs = O.listing(spark, root)
    sizes = [[f.size for f in O._packed_files(packs, p.spans)] for p in planned(root, listing=packs)]
    assert sum(map(len, sizes)) == 6 and all(len(p) == 1 or sum(p) + len(p) * O.OPEN_BYTES <= O.PARTITION_BYTES for p in sizes)


def test_a_file_deleted_since_is_an_error_row(spark):
    root = tempfile.mkdtemp(prefix="stored-")
    for name in ("a.txt", "b.txt"):
        open(f"{root}/{name}", "wb").close()
    df = O.stored_files(spark, root)
    os.remove(f"{root}/b.txt")
    assert {r.path: r.error for r in df.collect()} == {"a.txt": None, "b.txt": "Object not found: b.txt"}
    assert O.stored_files(spark, root).count() == 1


def test_spans_hold_each_pack_once():
    for found in ([("a", 5), ("b", 1), ("c", 9)], [("a", 1)], []):
        for most in (1, 2, 4, 15, 99):
            parts = O._spans(found, most)
            assert [(n, k) for p in parts for n, i, j in p.spans for k in range(i, j)] == [(n, k) for n, c in found for k in range(c)]
            assert len(parts) == min(most, sum(c for _, c in found))
