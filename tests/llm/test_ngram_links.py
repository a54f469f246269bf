"""Links that a clash of hashes, a token in every set or a split list could cost."""

import random

import numpy as np
import pytest

from docketlake.llm import ngram_join as J
from docketlake.llm.queries import queries

from ..conftest import SF
from .test_llm import brute_components, brute_sets, docs_of, near_copies


def packed(sets):
    ids = b"".join(k * 16 for k, _ in sets)
    return ids, np.array([len(t) for _, t in sets], np.uint32).tobytes(), np.array([x for _, t in sets for x in t], np.uint32).tobytes()


def test_clashing_tokens_of_a_set_count_one_by_one():
    ids, n = J._in_other_sets([packed([(b"A", [5, 5, 9]), (b"B", [5, 7])]), packed([(b"C", [7])]), packed([(b"A", [5, 5, 9])])])
    assert dict(zip([x.tobytes()[:1] for x in ids], n.tolist())) == {b"A": 2, b"B": 2, b"C": 1}
    assert len(J._in_other_sets([packed([(b"A", [1, 1])])])[0]) == 0


@pytest.mark.parametrize("options", [{"rounds": 0}, {"pivots": 1, "rounds": 0}])
def test_split_lists_lose_no_link(spark, options):
    rows = near_copies(8, 20, 9)
    assert {r["doc_id"]: r["component_id"] for r in J.similar_components(docs_of(spark, rows), **options).collect()} == brute_components(brute_sets(rows))


def test_a_passage_in_every_text(spark):
    r = random.Random(6)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for k in range(300):
        own = [f"w{r.randrange(10_000)}" for _ in range(r.choice((3, 8, 60)))] if k % 3 else rows[-1][1].split()[40:][:-1] + ["x"] if rows else ["y"]
        rows.append((k, f"{passage} {' '.join(own)}"))
    docs = docs_of(spark, rows)
    assert {x["doc_id"]: x["component_id"] for x in J.similar_components(docs, rounds=1).collect()} == brute_components(brute_sets(rows))
    # the passage's tokens are sent for two sets a task, and counted for the others
    sent = J._packed_tokens(docs.repartition(1), "doc_id", "text", 5, 80, 8).collect()
    tokens = np.concatenate([np.frombuffer(x["tokens"], np.uint32) for x in sent])
    assert np.unique(tokens, return_counts=True)[1].max() <= 2
    assert any(not x["tokens"] for x in sent)


def test_query_like_brute_force(spark):
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    sets = brute_sets(sorted(docs.items()))
    got = queries()["op1_ngram_join"](spark, SF).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == brute_components(sets)
    assert {x["doc_id"]: x["n_shingles"] for x in got} == {d: len(s) for d, s in sets.items()}


def test_columns_of_other_types_are_refused(spark):
    docs = spark.createDataFrame([("a", "b")], "doc_id string, text string")
    with pytest.raises(TypeError):
        J.similar_components(docs)
    with pytest.raises(ValueError):
        J.similar_components(docs_of(spark, []), words=17)


def test_linked_sets_are_at_most_a_band_apart():
    for n in range(1, 3000):
        for m in (n, -(-4 * n // 5)):  # 100 * m >= 80 * n
            bands = [int(np.floor(np.log(k) / np.log(1.25 * 1.0001))) for k in (m, n)]
            assert 0 <= bands[1] - bands[0] <= 1
