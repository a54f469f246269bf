"""Subword ids of whole texts through the tokenizers library, with a bounded memo.

A text is cut at spaces, tabs and line ends. For tokenizers that drop white
space, the ids of a text are the ids of these chunks in order, so each distinct
chunk is encoded once and then taken from a memo of bounded size. Where the
tokenizer splits texts into words as ``SPLIT`` says, texts of Latin-1 characters are
cut into these words at once: there are fewer of them than chunks, as a word stands
beside many marks. Many such texts are cut together, and each distinct word is looked up once.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa

#: White space of Unicode, as the tokenizer's normalizer and splitter know it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = re.compile("[\x1c-\x1f\u0300-\u036f]")
_CUT = re.compile("[\t\n\r ]+")

#: How a tokenizer normalizes and splits texts if ``words_of`` gives its words.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _latin(kind: Callable[[str], bool]) -> str:
    return "".join(re.escape(c) for c in map(chr, range(256)) if kind(c))


_L, _N = (_latin(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
_REST = _latin(lambda c: c not in "\t\n\x0b\x0c\r \x85\xa0" and unicodedata.category(c)[0] not in "LN")
#: A word of Latin-1 characters, which composition leaves as they are.
WORD = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[{_REST}]+")

#: Kinds of the Latin-1 characters: white space, letters, numerals (each a word of its own), others.
_KINDS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((_L, _N, _REST), 1):
    _KINDS[[k for k in range(256) if re.fullmatch(f"[{_chars}]", chr(k))]] = _k
_APOSTROPHE = ord("'")


def distinct(data: np.ndarray, kept: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that begin at ``bounds`` of the bytes ``kept``: each one's number among the distinct ones, their bytes and where these are cut."""
    offsets = np.concatenate([np.zeros(1, np.int32), np.cumsum(kept, dtype=np.int32)]).take(np.append(bounds, len(data)))
    found = pa.Array.from_buffers(pa.binary(), len(bounds), [None, pa.py_buffer(offsets), pa.py_buffer(data.compress(kept))]).dictionary_encode()
    _, cuts, words = found.dictionary.buffers()
    cuts = np.frombuffer(cuts, np.int32)[: len(found.dictionary) + 1]
    return found.indices.to_numpy(), np.frombuffer(words, np.uint8)[: cuts[-1]], cuts


def latin_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of lower-cased Latin-1 text are in words, and where words begin, as ``WORD`` finds them."""
    kind = _KINDS.take(data)
    edge = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)]) if len(data) else np.zeros(0, bool)
    mark = np.flatnonzero((data == _APOSTROPHE) & edge)
    a, b = (np.concatenate([data, np.zeros(2, np.uint8)])[mark + k] for k in (1, 2))
    one, two = np.isin(a, np.frombuffer(b"stmd", np.uint8)), np.zeros(len(mark), bool)
    for x, y in (b"re", b"ve", b"ll"):
        two |= (a == x) & (b == y)
    edge[mark[one | two] + 1] = False
    after = np.concatenate([mark[one] + 2, mark[two] + 3])
    edge[after[after < len(data)]] = True
    kept = kind > 0
    return kept, np.flatnonzero(edge & kept)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text; A-Z are lower-cased where that changes no id.

    ``str.split`` also cuts at U+001C to U+001F, which are no white space to the
    tokenizer, lower-casing before composition can matter before combining marks,
    and special tokens such as <|endoftext|> are matched before lower-casing; texts
    with any of these are cut plainly.
    """
    if "<|" in text or _ODD.search(text):
        return [c for c in _CUT.split(text) if c]
    return (text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode("utf-8")).split()


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text of Latin-1 characters; the chunks of any other.

    Texts with special tokens such as <|endoftext|> are cut into chunks.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return chunks_of(text)
    return chunks_of(text) if "<|" in text else WORD.findall(text.lower())


def cut_by(spec: dict) -> Callable[[str], list[str]]:
    """``words_of`` if a tokenizer's file splits texts into these words, ``chunks_of`` if not."""
    normal, split = ((spec.get(k) or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    return words_of if normal == NORMAL and split == SPLIT and all("<|" in t["content"] for t in spec["added_tokens"]) else chunks_of


def parts_of(text: str, chars: int = 1_000_000) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, cut) of parts of about ``chars``, each ending at white space or the end.

    ``cut`` is False for a longer stretch that has no white space to be cut at.
    """
    at, n = 0, len(text)
    while n - at > chars:
        end = 1 + max(text.rfind(c, at, at + chars) for c in " \n\t\r")
        if end:
            yield at, end, True
        else:
            m = _CUT.search(text, at + chars)
            end = m.start() if m else n
            yield at, end, False
        at = end
    if at < n or not n:
        yield at, n, True


def segments(text: str, chars: int = 1_000_000) -> Iterator[str]:
    """The text in segments cut at white space, of about ``chars`` where it has any."""
    return (text[a:b] for a, b, _ in parts_of(text, chars))


def oldest_half(held: dict) -> dict:
    """The entries of a memo that came first, mostly the frequent ones."""
    return dict(islice(held.items(), len(held) // 2))


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The memo holds at most ``memo`` words or chunks besides those of one slice of texts;
    any over ``longest`` characters are never held.
    """

    def __init__(self, path: str, memo: int = 400_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut, suffix = cut_by(spec), spec["model"].get("end_of_word_suffix")
        vocab = spec["model"]["vocab"]
        #: whether an id ends a word
        self.ends = np.zeros(1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]), bool)
        self.ends[[k for t, k in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.memo, self.longest, self.held = memo, longest, {}

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of single words, encoded as one text and cut after the ids that end words."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        if len(ends) != len(words):
            return self._ids(words)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.cut is not words_of:
            return self._encode(texts)
        latin: list[bytes | None] = []
        for x in texts:
            try:
                latin.append(x.lower().encode("latin-1") if len(x) <= 1_000_000 and "<|" not in x else None)
            except UnicodeEncodeError:
                latin.append(None)
        rest, some = iter(self._encode([x for x, y in zip(texts, latin) if y is None])), iter(self._latin_ids([y for y in latin if y is not None]))
        return [next(rest if y is None else some) for y in latin]

    def _latin_ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased Latin-1 texts: each distinct word is looked up once."""
        if not texts:
            return []
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        kept, bounds = latin_words(data)
        if not len(bounds):
            return [b""] * len(texts)
        codes, text, cuts = distinct(data, kept, bounds)
        text, cuts, held = text.tobytes().decode("latin-1"), cuts.tolist(), self.held
        words = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        found = list(map(held.get, words))
        new = [w for w, x in zip(words, found) if x is None]
        if new:
            for at in range(0, len(new), 20_000):
                held.update(zip(new[at : at + 20_000], self._word_ids(new[at : at + 20_000])))
            found = [held[w] if x is None else x for w, x in zip(words, found)]
        flat, size = np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4
        for w in new:
            if len(w) > self.longest:
                del held[w]
        if len(held) > self.memo:
            self.held = oldest_half(held)
        n = size.take(codes)
        ends = np.cumsum(n)
        place = np.repeat(((np.cumsum(size) - size).take(codes) - (ends - n)).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = flat.take(place).tobytes()
        begin = np.cumsum([0, *(len(x) + 1 for x in texts)])
        parts = (4 * np.concatenate([[0], ends])[np.searchsorted(bounds, begin)]).tolist()
        return [ids[a:b] for a, b in zip(parts, parts[1:])]

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = self.cut
        parts = [[cut(s) for s in segments(x)] if len(x) > 1_000_000 else [cut(x)] for x in texts]
        held = self.held
        new = list({c for x in parts for p in x for c in p if c not in held})
        words = [c for c in new if WORD.fullmatch(c)] if cut is words_of else []
        single = set(words)
        for some, ids in ((words, self._word_ids), ([c for c in new if c not in single], self._ids)):
            for at in range(0, len(some), 20_000):
                held.update(zip(some[at : at + 20_000], ids(some[at : at + 20_000])))
        get = held.__getitem__
        out = [b"".join([b"".join(map(get, p)) for p in x]) for x in parts]
        for c in new:
            if len(c) > self.longest:
                del held[c]
        if len(held) > self.memo:
            self.held = oldest_half(held)
        return out


@lru_cache(maxsize=2)
def chunk_encoder(path: str, memo: int) -> ChunkEncoder:
    """One encoder a Python worker, so that its memo serves task after task."""
    return ChunkEncoder(path, memo)
