"""Runs of letters longer than a word."""

import random

from docketlake.llm import language_id as L


def test_every_letter_and_3_gram_of_a_run_counts():
    for n in (1, 31, 32, 33, 34, 62, 63, 64, 100, 1000):
        run = "".join(random.Random(n).choice("abcdefgh") for _ in range(n))
        pieces = L.words_of(f"x {run} y")[1:-1]
        assert max(map(len, pieces)) <= 32 and pieces[0] + "".join(p[2:] for p in pieces[1:]) == run
    assert L.words_of("Short words STAY") == ["short", "words", "stay"]


def test_a_switch_within_a_run_is_seen():
    texts = {"aa": ["abab baba abba baab aabb bbaa abab baba " * 4] * 5, "cc": ["cdcd dcdc cddc dccd ccdd ddcc cdcd dcdc " * 4] * 5}
    field = L.LanguageField(["aa", "cc"]).fit(texts)
    post = L.Labeller(field).posteriors(["ab" * 300 + "cd" * 300])[0]
    assert list(post[[0, 5, -6, -1]].argmax(1)) == [0, 0, 1, 1]
    assert abs(post.mean(0)[0] - 0.5) < 0.1


def test_no_letter_no_language():
    for text in ("½ ² ①", "Ⅷ ⅱ 12 ³", "!?", "\u0301"):
        assert L.words_of(text) == []
    assert L.words_of("x² नमस्ते ª") == ["x", "नमस्ते", "ª"]


def test_features_hold_what_they_name():
    def of(word):
        w = L.Words([word, "other"])
        return set(w.flat[w.owner == 0].tolist())

    assert len(of("abcdef")) == 1 + 7 + 6 + 6  # the word, 2- and 3-grams with borders, affixes
    assert of("abcdef") == set(L.Words(["first", "abcdef"]).flat[L.Words(["first", "abcdef"]).owner == 1].tolist())
    shared = of("abcdef") & of("abcxyz")
    assert len(shared) == 3 + 3 + 2  # prefixes; <a ab bc; <ab abc
