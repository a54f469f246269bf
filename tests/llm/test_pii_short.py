"""Written-out addresses of few digits."""

import pytest

from docketlake.llm import pii


@pytest.mark.parametrize("address", ["10[.]0[.]0[.]1", "127[.]0[.]0[.]1", "10[.]1[.]2[.]34", "0[.]0[.]0[.]0", "8 . 8 . 8 . 8", "192[.]168[.]0[.]1", "8 [.] 8 [.] 4 [.] 4"])
def test_short_addresses_are_found(address):
    base, every = pii.find_spans(f"the resolver is {address} as the note says", pii.trained_field())
    assert base == [] and every == [("ip_like", 16, 16 + len(address))]


@pytest.mark.parametrize("text", ["score 1 2 3 4 in order", "section 3. 4. 5. 6 of it", "999[.]1[.]2[.]3 is none", "chapter 1 . 2 . 3 shows"])
def test_lists_of_numbers_are_no_addresses(text):
    assert pii.find_spans(text, pii.trained_field()) == ([], [])
