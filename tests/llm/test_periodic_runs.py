"""Runs of repeated words against the definition, the query against a plain reading of its contract."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from docketlake.llm import periodic_runs as pr
from docketlake.llm.queries import queries

from ..conftest import SF
from .test_llm import awkward, docs_of, empty


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute_runs(words):
    """By the definition: every maximal stretch of every period whose smallest period that is."""
    out, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = first - q, i - first + q
            if length >= max(24, 3 * q) and smallest_period(words[start:i]) == q:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


def runs_of(texts):
    ids = [pr.word_ids(t.encode()) for t in texts]
    return pr.diagonal_runs(np.concatenate(ids), np.cumsum([0, *map(len, ids)]))


def test_runs_of_random_words():
    r = random.Random(5)
    for _ in range(60):
        texts = []
        for _ in range(r.randint(1, 6)):
            words = []
            for _ in range(r.randint(0, 4)):
                some = [r.choice("abc" if r.random() < 0.5 else "abcdefghijklmn") for _ in range(r.randint(1, 40))]
                words += some * r.choice((1, 1, 3, 4, 9)) + some[: r.randint(0, len(some))]
                if words and r.random() < 0.3:
                    words[r.randrange(len(words))] = "zz"
            texts.append(" ".join(words))
        assert runs_of(texts) == [brute_runs(t.split()) for t in texts]


def test_windows_do_not_cross_texts():
    assert runs_of(["a b c " * 4, "a b c " * 5]) == [[], []]
    assert runs_of(["", "x " * 24, "", "x " * 23]) == [[], [(0, 24, 1)], [], []]


def test_thue_morse_words_have_no_run():
    word = "a"
    for _ in range(14):
        word += word.translate(str.maketrans("ab", "ba"))
    assert runs_of([" ".join(word)]) == [[]]


def test_words_that_hash_alike_are_told_apart(monkeypatch):
    monkeypatch.setattr(pr, "mixed", lambda x, seed=0: x * np.uint64(0))
    assert runs_of(["p q r s t u v w x y z " + "a b c d e f g h i j k l m n o " * 2]) == [[]]


@pytest.mark.parametrize("text,runs", [("a " * 400_000, [(0, 400_000, 1)]), (" ".join(map(str, range(130_000))) + " " + "the end of it " * 60_000, [(130_000, 240_000, 4)]), ((" ".join(map(str, range(90_000))) + " ") * 4, [(0, 360_000, 90_000)])])
def test_long_texts_take_little_time(text, runs):
    began = time.process_time()
    assert runs_of([text]) == [runs] and time.process_time() - began < 5


def test_stretches_are_joined(monkeypatch):
    text = ("ab cd\tef  gh\n" * 30).encode()
    whole, kept = pr.word_ids(text).tolist(), pr._kept_text(text, None, None)
    monkeypatch.setattr(pr, "SPAN", 17)
    assert pr.word_ids(text).tolist() == whole and pr._kept_text(text, None, None) == kept == b" ".join(text.split())


def rows_of(df):
    return sorted((tuple(r) for r in pr.run_digests(pr.periodic_runs(df, pr.repeated_tail)).collect()), key=repr)


def test_query_is_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries()["op12_periodic_runs"](spark, SF).collect())
    assert got == sorted(brute_row(d, t) for d, t in docs)
    assert sum(r[1] > 0 for r in got) > len(got) // 20


def test_awkward_rows(spark):
    assert rows_of(empty(spark)) == []
    df = awkward(spark)
    small = [(r.doc_id, r.text) for r in df.collect() if r.text is None or len(r.text) < 10_000]
    assert rows_of(docs_of(spark, small)) == sorted((brute_row(d, t) for d, t in small), key=repr)
    assert len(rows_of(df)) == df.count()


def test_collapsed_text(spark):
    out = pr.periodic_runs(docs_of(spark, [(1, "so " + "on and " * 12 + "end")])).first()
    assert [tuple(r) for r in out.runs] == [(1, 24, 2)] and out.collapsed == "so on and end"
