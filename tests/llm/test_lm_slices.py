"""Words and hashes of many texts at once, and windows whose places are computed once."""

import random

import numpy as np
import pytest

from docketlake.llm import lm_scoring, subwords
from docketlake.llm.lm_scoring import STRIDE, WINDOW, AttentionModel, _exp_back
from docketlake.llm.queries import WORD_BPE
from docketlake.llm.shingles import distinct_hashes, word_hashes


@pytest.mark.parametrize("alphabet", ["'''stmdrevl lleEL5½ªß\xa0\x85\n\t .,-\x1cÀÿ×", "'stmdrevl ", "".join(map(chr, range(256)))])
def test_latin_words_are_those_of_the_pattern(alphabet):
    r = random.Random(5)
    for _ in range(1000):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(25))).lower()
        data = np.frombuffer(text.encode("latin-1"), np.uint8)
        kept, bounds = subwords.latin_words(data)
        codes, words, cuts = subwords.distinct(data, kept, bounds)
        assert [words[cuts[k] : cuts[k + 1]].tobytes().decode("latin-1") for k in codes] == subwords.WORD.findall(text)


def test_many_texts_are_encoded_as_each_alone():
    texts = ["It's ONE, two.", "", "日本 one's", " \n", "<|endoftext|> x", "'ll 'llama Straße", "one two one", "w" * 70 + " w"]
    together = subwords.ChunkEncoder(WORD_BPE)
    assert together.encode(texts) == [subwords.ChunkEncoder(WORD_BPE)._encode([x])[0] for x in texts]
    assert together.encode(texts[::-1])[::-1] == together.encode(texts) and "w" * 70 not in together.held


def test_distinct_hashes_are_those_of_the_words():
    for texts in ([""], ["", " \t"], ["One one two", "", "zwei ZWEI ÄÖ\x85x 😀", "two"]):
        h, codes, n = distinct_hashes(texts)
        assert len(set(h.tolist())) == len(h) and n.tolist() == [len(word_hashes(x)) for x in texts]
        assert h[codes].tolist() == [y for x in texts for y in word_hashes(x).tolist()]


def test_places_in_an_overlap_are_not_computed_twice(monkeypatch):
    m, places = AttentionModel(40, 38, 39), []
    shares = lm_scoring._log_shares
    monkeypatch.setattr(lm_scoring, "_log_shares", lambda tokens, t, top, first, value: places.append(len(tokens) * (WINDOW - first)) or shares(tokens, t, top, first, value))
    lm_scoring.attention_scores([np.zeros(WINDOW + 3 * STRIDE - 1, np.int64)], m.tables(np.ones((lm_scoring.CLASSES, 40))), 38, 39)
    assert sum(places) == WINDOW + 3 * STRIDE


@pytest.mark.parametrize("scale", [1.0, 100.0])
def test_exp_back(scale):
    r = np.random.default_rng(1)
    s, rel = (r.normal(0, scale, (2, WINDOW - 4, WINDOW))).astype(np.float32), r.normal(0, 1, WINDOW).astype(np.float32)
    want = np.float64(s)
    for i in range(WINDOW - 4):
        want[:, i, : i + 5] += rel[i + 4 - np.arange(i + 5)]
        want[:, i, i + 5 :] = -np.inf
    want = np.exp(want - want.max(2, keepdims=True))
    _exp_back(s, rel, 4)
    assert s / s.sum(2, keepdims=True) == pytest.approx(want / want.sum(2, keepdims=True), abs=1e-5)
