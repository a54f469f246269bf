"""Vectors by the index of their replies."""

import random

from docketlake.sources.embed import HashingEmbedder, embed, embed_by_index, placed


class Shuffled:
    """Replies in any order, leaves some out at first, fails on requests that hold a bad text."""

    def __init__(self, seed=1):
        self.plain, self.r = HashingEmbedder(8), random.Random(seed)

    def __call__(self, texts, use):
        if any("bad" in t for t in texts):
            raise ValueError("rejected input")
        replies = list(enumerate(self.plain(texts, use)))
        self.r.shuffle(replies)
        return replies[: max(1, len(replies) * 2 // 3)] + [(99, [0.0]), replies[0]]


def test_same_vectors_and_one_error_a_bad_text(spark):
    texts = [f"text number {k}" for k in range(40)] + ["bad one", None, "", "bad two"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string").coalesce(1)
    want = {r.id: r.embedding for r in embed(rows, HashingEmbedder(8)).collect()}
    got = embed_by_index(rows, Shuffled(), batch=16, tries=8).collect()
    for r in got:
        if r.content and "bad" in r.content:
            assert r.embedding is None and r.embedding_error == "rejected input"
        else:
            assert r.embedding == want[r.id] and r.embedding_error is None


def test_missing_replies_and_passing_failures():
    assert placed(["a", "b"], lambda t, u: [(0, [1.0])] if "a" in t else [], tries=3) == [([1.0], None), (None, "No embedding was returned")]
    calls = []

    def flaky(texts, use):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("busy")
        return [(k, [2]) for k in range(len(texts))]

    assert placed(["a"], flaky) == [([2.0], None)] and calls == [1, 1, 1]
    assert placed([], flaky) == []
