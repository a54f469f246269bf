"""Texts of Latin-1 characters are cut into the tokenizer's words, and these are held."""

import random
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docketlake.llm.subwords import ChunkEncoder, chunks_of, cut_by

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    some = [*map(chr, range(256)), *"'''''stremvdl<|> ", "</w>", "<|endoftext|>", "’", "é", "日"]
    return ["", "it's 'stand'S &&'t \xc9T\xc9\xb2 a\x1cb", *("".join(r.choices(some[:-4] if k % 3 else some, k=r.randrange(40))) for k in range(3000))]


def test_words_have_the_librarys_ids(texts):
    library = Tokenizer.from_file(PATH)
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert [array("I", x).tolist() for x in ChunkEncoder(PATH).encode(texts)] == want


def test_a_word_beside_many_marks_is_held_once():
    encoder = ChunkEncoder(PATH)
    encoder.encode(["Word, word. (word) word***"])
    assert set(encoder.held) == {"word", ",", ".", "(", ")", "***"}


def test_other_tokenizers_keep_their_chunks():
    assert cut_by({"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}}) is chunks_of
