"""The transducer's memo holds words, not every pair of a word and its marks."""

import public_tokenizers
from tokenizers import Tokenizer

from docketlake.llm.bpe import BpeCodec

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_are_held_and_results_stay():
    codec, library = BpeCodec(PATH), Tokenizer.from_file(PATH)
    text = "Straße, straße. (straße) it's\x1c'S \xe9t\xe9\xb2*** </w> 'stand"
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    n, _, shown, running = codec.digests(text)
    assert n == len(ids)
    plain = BpeCodec(PATH, longest=0)  # holds nothing
    assert plain.digests(text) == (n, *codec.digests(text)[1:3], running)
    assert {"straße", ",", ".", "(", ")"} <= set(codec.held) and "straße," not in codec.held
