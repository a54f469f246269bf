"""Freed memory goes back once a task's input has ended."""

import pyarrow as pa

from docketlake.llm import common


def test_rows_pass_and_memory_is_given_back(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append(1))
    batches = [pa.RecordBatch.from_arrays([pa.array([k])], names=["a"]) for k in range(3)]
    run = common.releasing(lambda given: (b for b in given))(iter(batches))
    assert next(run).to_pydict() == {"a": [0]} and told == []
    assert [b.to_pydict()["a"] for b in run] == [[1], [2]] and told == [1]


def test_worker_memory_shrinks():
    held = [bytes(1000) for _ in range(200_000)]
    full = resident()
    held = held[::50]  # freed in between, so the heap's end is still used
    common.give_back()
    assert resident() < full - 50 and len(held) == 4000


def resident():
    with open("/proc/self/status") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("VmRSS")) / 1024
