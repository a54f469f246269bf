"""The BPE transducer: every word goes through it, tokens come early, memory stays constant."""

import random
import tracemalloc
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docketlake.llm.bpe import BpeCodec, BpeModel
from docketlake.llm.subwords import ChunkEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return BpeCodec(PATH)


def test_same_as_batch_merging():
    r, model = random.Random(4), BpeModel(PATH)
    for n in range(60):
        word = "".join(r.choice("etaonrishdl" if n % 2 else "ab🙏😂é") for _ in range(r.randint(1, 1500)))
        symbols = list("".join(model.symbols([word, ""])))
        for step in (1, 8, 64):
            assert list(model.transduce(iter(symbols), step)) == model.merged(symbols.copy())


def test_tokens_come_before_the_words_end():
    model = BpeModel(PATH)
    for word in ("internationalisation" * 40, "abcdefghij" * 80, "😂" * 300):
        read, ahead = [0], []

        def counted():
            for s in "".join(model.symbols([word, ""])):
                read[0] += 1
                yield s

        out = 0
        for token in model.transduce(counted(), 1):
            out += len(token)
            ahead.append(read[0] - out)
        assert out == read[0] == len(word.encode())
        # no token waits for more than the lookahead, and most for less than the longest token and one symbol
        assert max(ahead) <= model.lookahead and sorted(ahead)[len(ahead) // 2] <= 33
        assert sum(k > 0 for k in ahead) > 0.8 * len(ahead)


def test_memory_stays_constant(codec):
    def peak(n):
        text = "xq\u4e2dé" * n
        tracemalloc.start()
        total = sum(len(ids) for ids, _, _ in codec._parts(text, 0, len(text)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total > 4 * n
        return most

    peak(8000)
    assert peak(40_000) < 1.3 * peak(10_000) + 2e6


ODD = ["<|", "|>", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|endof", "text|>", "<", "|", ">", "endoftext", " ", "\n", "A", "é", "É", "e\u0301", "\u0301", "'", "'S", "'ll", "don't", "1", "23", "!", "?!'", "Σ", "ς", "İ", "中文", "\u1112\u1161\u11ab", "\x1c", "\x85", "\u00a0", "ab" * 20, "😀"]


def test_mixed_special_tokens_like_the_library(library, codec):
    r, encoder = random.Random(9), ChunkEncoder(PATH)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(1, 14))) for _ in range(6000)]
    for text, data in zip(texts, encoder.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want and array("I", data).tolist() == want, text


def test_blocks_of_any_size_give_the_same_words(library, codec):
    r, model = random.Random(11), codec.model
    for _ in range(400):
        text = "".join(r.choice(ODD) for _ in range(30)).replace(" ", "").replace("\n", "")
        whole = list(model.words(text, 0, len(text)))
        for block in (1, 2, 3, 7):
            parts = "\0".join(model.words(text, 0, len(text), block)).replace("\0\0", "\1").replace("\0", "")
            assert [w for w in parts.split("\1") if w] == [w for w in whole if w], (text, block)


def test_a_long_stretch_without_white_space(library, codec):
    text = "start " + "".join(random.Random(3).choice("abcdé'1!") for _ in range(1_050_000)) + " end"
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
