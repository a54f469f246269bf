"""Special tokens in mixed case: the ids are those of the library."""

from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docketlake.llm.bpe import BpeCodec
from docketlake.llm.subwords import ChunkEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("text", ["<|ENDOFTEXT|>", "<|StartOfText|> A Lease", "see <|endoftext|> and <|EndOfText|>", "É <|ENDOFTEXT|>x", "A <|b|> C", "a<|EndOfText|>B <|endoftext|>c"])
def test_ids_like_the_library(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert list(array("I", ChunkEncoder(PATH).encode([text])[0])) == want
    assert BpeCodec(PATH).encode(text) == want
