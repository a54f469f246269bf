"""Byte-pair encoding as a streaming transducer with bounded lookahead.

A token sequence is what the merge list makes of a text exactly if each two
neighbours are what it makes of the two alone: merges apply by rank, leftmost first,
so the first one over a border would also come first between the two tokens. So the
encoding of every prefix of a word ends in one token that fits the encoding of the
prefix before it, and the transducer reads symbol by symbol and keeps, for each
place where a token of the text to come may still begin, the last token of the
prefix that ends there. What all those prefixes begin with can't change any more
and is emitted at once. The merge list's sufficient lookahead bounds how long that
can take, so memory is constant however long the word. Words end tokens, and so does
the end of the input. Decoding feeds the pieces' bytes to a state machine that holds
at most the bytes of one open character.

Nothing here needs the tokenizers library; the vocabulary file is read as JSON.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import text_slices
from docketlake.llm.subwords import WHITE, cut_by, oldest_half, parts_of

#: The splitting pattern of the vocabulary, without its white space.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
_LETTERS = regex.compile(r"\p{L}+")
_OTHERS = regex.compile(rf"[^{WHITE}\p{{L}}\p{{N}}]+")
LAST = 0x1000  # added to the code of a word's last symbol where the vocabulary marks word ends


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


def marked(symbols: str) -> str:
    """Symbols, one character each, with the last one marked as a word's end."""
    return symbols[:-1] + chr(ord(symbols[-1]) + LAST)


@lru_cache(maxsize=1)
def _composing() -> frozenset[str]:
    """Characters that composition may join to the one before them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x80, 0x110000))
    return frozenset([chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"] + [chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))])


def _starts(c: str) -> bool:
    """Whether composition of what stands before ``c`` ends there."""
    return c.isascii() or unicodedata.combining(c) == 0 and c not in _composing()


def sufficient_lookahead(merges: Iterable[tuple[str, str]]) -> int:
    """How many symbols after a token's end decide whether the token is final.

    ``reach[x]`` is the most symbols to the right of a token x that rules read so
    far can make matter to it: a rule (x, c) needs c's symbols and whatever
    matters to c, or to a token at c's right edge, through rules of lower rank.
    One longest token is added for rules that start inside the token.
    """
    reach: dict[str, int] = {}
    right: dict[str, str] = {}
    longest = 1
    for a, b in merges:
        edge, at = 0, b
        while at is not None:
            edge = max(edge, reach.get(at, 0))
            at = right.get(at)
        reach[a] = max(reach.get(a, 0), len(b) + edge)
        right.setdefault(a + b, b)
        longest = max(longest, len(a + b))
    return max(reach.values(), default=0) + longest


class BpeModel:
    """A merge list with its ids, special tokens and sufficient lookahead.

    Inside, a token is a string with one character a symbol; the last symbol of a
    word is a character of its own. Every token needs one rule that makes it, of parts
    made by earlier rules, as in any list that training gives.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.cut = cut_by(spec)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = {self._inner(t): k for t, k in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(map(self._inner, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.pieces = {v: k for k, v in (model["vocab"] | self.special).items()}
        self.lookahead = sufficient_lookahead(merges)
        self.alphabet = byte_alphabet()
        self.bytes_of = {c: b for b, c in enumerate(self.alphabet)}
        self.special_cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.parts = {a + b: (a, b) for a, b in merges}
        made = {a + b: k for (a, b), k in self.rank.items()}
        if len(made) < len(merges) or any(made.get(x, -1) >= k for (a, b), k in self.rank.items() for x in (a, b)):
            raise ValueError("every token needs one rule, of parts made by earlier rules")
        #: 2 for a token, 1 for what a longer token begins with, 3 for both
        self.kinds = dict.fromkeys(self.ids, 2)
        for t in self.ids:
            for k in range(1, len(t)):
                self.kinds[t[:k]] = self.kinds.get(t[:k], 0) | 1
        self._known: dict[tuple[str, str], bool] = {}
        self._right: dict[str, list[tuple[str, float]]] = {}
        self._left: dict[str, list[tuple[str, float]]] = {}
        self._whole: dict[str, bool] = {}

    def _inner(self, token: str) -> str:
        bare = token.removesuffix(self.suffix) if self.suffix else token
        return marked(bare) if self.suffix and bare and bare != token else token

    def merged(self, symbols: list[str]) -> list[str]:
        """The merge list applied: always the lowest rank, leftmost first."""
        rank, none = self.rank.get, 1 << 60
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (low := min(ranks)) != none:
            k = ranks.index(low)
            joined = symbols[k] + symbols.pop(k + 1)
            symbols[k] = joined
            del ranks[k]
            if k:
                ranks[k - 1] = rank((symbols[k - 1], joined), none)
            if k < len(ranks):
                ranks[k] = rank((joined, symbols[k + 1]), none)
        return symbols

    def _edge(self, token: str, side: int, held: dict) -> list[tuple[str, float]]:
        """The parts at a token's edge, each with the rank that joins it to the rest."""
        out, until = [], float("inf")
        x = token
        while True:
            out.append((x, until))
            if x not in self.parts:
                break
            until = self.rank[self.parts[x]]
            x = self.parts[x][side]
        held[token] = out
        return out

    def fits(self, a: str, b: str, held: int = 200_000) -> bool:
        """Whether the merge list leaves the border between tokens ``a`` and ``b`` alone.

        ``a`` is empty where a word begins. Up to ``held`` answers are kept.
        """
        known = self._known.get((a, b))
        if known is None:
            if len(self._known) >= held:
                self._known.clear()
            known = self._known[a, b] = self._border(a, b)
        return known

    def _border(self, a: str, b: str) -> bool:
        """A rule over the border acts if no rule takes away either of its parts first; of
        equal ranks the left one acts first."""
        whole = self._whole.get(b)
        if whole is None:
            whole = self._whole[b] = self.merged(list(b)) == [b]
        if not whole or not a:
            return whole
        rank = self.rank.get
        left = self._left.get(b) or self._edge(b, 0, self._left)
        for x, x_until in self._right.get(a) or self._edge(a, 1, self._right):
            for y, y_until in left:
                r = rank((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def transduce(self, symbols: Iterable[str], step: int = 16) -> Iterator[str]:
        """Tokens of words, each emitted once nothing to come can change it.

        ``symbols`` is read once, in strings of any length; an empty string ends a word.
        What is settled is looked for after every ``step`` symbols of a word.
        """
        kinds, known, fits = self.kinds.get, self._known.get, self.fits
        word, tokens, begins = "", [""], [0]  # from the settled place on: symbols, and each prefix's last token
        walks: list[int] = []  # where tokens that may still grow begin
        at = 0
        for part in symbols:
            if not part:
                yield from self._path(tokens, begins, at)
                word, tokens, begins, walks, at = "", [""], [0], [], 0
                continue
            word += part
            n = len(word)
            while at < n:
                walks.append(at)
                at += 1
                still, token, of = [], "", 0
                for begin in walks:
                    text = word[begin:at]
                    kind = kinds(text)
                    if kind is None:
                        continue
                    if kind > 1 and not token:
                        before = tokens[begin]
                        fit = known((before, text))
                        if fits(before, text) if fit is None else fit:
                            token, of = text, begin
                    if kind & 1:
                        still.append(begin)
                walks = still
                tokens.append(token)
                begins.append(of)
                if at % step == 0 and (k := self._settled(begins, [*walks, at])):
                    yield from self._path(tokens, begins, k)
                    word, tokens, begins = word[k:], tokens[k:], [b - k for b in begins[k:]]
                    walks, at, n = [b - k for b in walks], at - k, n - k
        yield from self._path(tokens, begins, at)

    @staticmethod
    def _path(tokens: list[str], begins: list[int], at: int) -> list[str]:
        out = []
        while at:
            out.append(tokens[at])
            at = begins[at]
        return out[::-1]

    @staticmethod
    def _settled(begins: list[int], live: list[int]) -> int:
        """The farthest place that the encodings of all live prefixes share."""
        shared = live[0]
        for k in live:
            while k != shared:  # go back from the farther one until both meet
                if k > shared:
                    k = begins[k]
                else:
                    shared = begins[shared]
        return shared

    def symbols(self, words: Iterable[str]) -> Iterator[str]:
        """Symbols of words that come in parts; an empty part, and so string, ends a word."""
        alphabet, before = self.alphabet, ""
        for part in words:
            if part:
                now = "".join([alphabet[b] for b in part.encode("utf-8", "replace")])
                now = before + now
                before = now[-1]
                for k in range(0, len(now) - 1, 256):
                    yield now[k : min(k + 256, len(now) - 1)]
            elif before:
                yield marked(before) if self.suffix else before
                yield ""
                before = ""

    def words(self, text: str, a: int, b: int, block: int = 1 << 16) -> Iterator[str]:
        """The words of ``text[a:b]``, normalised, in parts; an empty part ends a word.

        The text is read in blocks of about ``block`` characters, cut where composition
        can't reach over; of a word longer than that no more than a block is held.
        """
        held, running = "", None
        while a < b:
            cut = min(b, a + block)
            while cut < b and not _starts(text[cut]):
                cut += 1
            held += self.normalised(text[a:cut])
            a, at = cut, 0
            if running:
                if m := running.match(held):
                    yield m[0]
                    at = m.end()
                if at < len(held):
                    yield ""
                    running = None
            if running:
                held = ""
                continue
            rest = len(held)
            for m in WORDS.finditer(held, at):
                if a < b and held[m.start()] == "'" and m.start() >= len(held) - 3:
                    rest = m.start()  # the next characters decide
                    break
                yield m[0]
                if a < b and m.end() == len(held) and (_LETTERS.match(m[0][0]) or _OTHERS.match(m[0])):
                    running = _LETTERS if _LETTERS.match(m[0][0]) else _OTHERS
                else:
                    yield ""
            held = held[rest:]
        if running:
            yield ""

    def normalised(self, text: str) -> str:
        """Composed and lower-cased letter by letter (no final-sigma rule)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def chunk_ids(self, text: str, a: int = 0, b: int | None = None) -> Iterator[int]:
        """Ids of ``text[a:b]``, which has no white-space cuts inside; special tokens count as such."""
        ids, b = self.ids, len(text) if b is None else b
        for m in self.special_cut.finditer(text, a, b) if self.special_cut else ():
            for t in self.transduce(self.symbols(self.words(text, a, m.start()))):
                yield ids[t]
            yield self.special[m[0]]
            a = m.end()
        for t in self.transduce(self.symbols(self.words(text, a, b))):
            yield ids[t]


class TextDecoder:
    """Bytes to text, one piece after another.

    State: the bytes of the character that is open, at most three. Bytes that
    can't continue become U+FFFD, as in the usual replacement rule.
    """

    def __init__(self):
        self.open = b""

    def feed(self, data: bytes, final: bool = False) -> str:
        if not self.open and data.isascii():
            return data.decode("ascii")
        data = self.open + data if self.open else data
        cut = len(data)
        if not final and not data.isascii():
            for back in range(1, min(4, len(data)) + 1):
                b = data[-back]
                if b >= 0xC0:
                    need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                    if need > back:
                        cut = len(data) - back
                    break
                if b < 0x80:
                    break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")


#: ids, the pieces joined by spaces, the running text
Part = tuple[bytes, bytes, bytes]


class BpeCodec:
    """Encodes and decodes whole texts with a memo of bounded size."""

    def __init__(self, path: str, memo: int = 600_000, longest: int = 64):
        self.model = BpeModel(path)
        self.memo, self.longest = memo, longest
        self.held: dict[str, Part] = {}
        model, special = self.model, set(self.model.special.values())
        #: what decoding emits for an id: its piece's own characters, or the bytes it stands for
        self.shown = {k: v.encode("utf-8") for k, v in model.pieces.items()}
        self.raw: dict[int, bytes] = {}
        for k, piece in model.pieces.items():
            word = k not in special and model.suffix and piece.endswith(model.suffix)
            bare = piece.removesuffix(model.suffix) if word else piece
            self.raw[k] = piece.encode("utf-8") if k in special else bytes(model.bytes_of[c] for c in bare) + (b" " if word else b"")

    def _parts(self, text: str, a: int, b: int, most: int = 1 << 16) -> Iterator[Part]:
        """The parts of ``text[a:b]``, which has no white-space cuts, of at most ``most`` ids each."""
        state, ids = TextDecoder(), array("I")
        for k in self.model.chunk_ids(text, a, b):
            ids.append(k)
            if len(ids) == most:
                yield self._part(ids, state)
                ids = array("I")
        if ids:
            yield self._part(ids, state, True)

    def _part(self, ids: array, state: TextDecoder, final: bool = False) -> Part:
        raw, shown = self.raw, self.shown
        text = "".join([state.feed(raw[k]) for k in ids]) + (state.feed(b"", True) if final else "")
        return ids.tobytes(), b" ".join([shown[k] for k in ids]), text.encode("utf-8", "replace")

    def _entry(self, chunk: str) -> Part:
        parts = list(self._parts(chunk, 0, len(chunk)))
        if len(parts) == 1:
            return parts[0]
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts]), b"".join([p[2] for p in parts])

    def stream(self, text: str) -> Iterator[Part]:
        """The text part by part; parts without ids are left out.

        A stretch of over a million characters without white space goes through the
        transducer in parts of bounded size, as it is.
        """
        for a, b, cut in parts_of(text):
            if not cut:
                yield from self._parts(text, a, b)
                continue
            chunks, held = self.model.cut(text if b - a == len(text) else text[a:b]), self.held
            for c in set(chunks).difference(held):
                if len(c) <= self.longest:
                    held[c] = self._entry(c)
            try:
                found = [x for x in map(held.__getitem__, chunks) if x[0]]
            except KeyError:
                found = [x for x in (held[c] if c in held else self._entry(c) for c in chunks) if x[0]]
            if found:
                ids, shown, running = zip(*found)
                yield b"".join(ids), b" ".join(shown), b"".join(running)
            if len(held) > self.memo:
                self.held = oldest_half(held)

    def digests(self, text: str) -> tuple[int, str, str, str]:
        """Number of ids, digests of the ids, of the decoded pieces and of the running text."""
        n, ids, shown, running, space = 0, sha256(), sha256(), sha256(), b""
        for a, b, c in self.stream(text):
            ids.update(a)
            shown.update(b" " + b if n else b)
            n += len(a) // 4
            bare = (space + c).rstrip(b" ")
            space = b" " * (len(space) + len(c) - len(bare))
            running.update(bare)
        return n, ids.hexdigest(), shown.hexdigest(), running.hexdigest()

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join(x[0] for x in self.stream(text))).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The pieces joined by spaces, as for a vocabulary without a decoder."""
        state, shown = TextDecoder(), self.shown
        return " ".join([state.feed(shown[k]) for k in ids if k in shown]) + state.feed(b"", True)

    def text(self, ids: Iterable[int]) -> str:
        """The running text: pieces' bytes, a space after each end of word but the last."""
        state = TextDecoder()
        return ("".join([state.feed(self.raw[k]) for k in ids]) + state.feed(b"", True)).rstrip(" ")


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> of every whole text; null and empty texts give no ids."""

    def run(batches):
        c = codec(tokenizer_path)
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([c.encode(x) for x in texts], pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", joined: bool = False) -> DataFrame:
    """id, text of rows (id, ids); null ids give an empty text.

    ``joined`` joins the pieces by spaces; otherwise the bytes of the pieces make
    the text, with one space after each word.
    """

    def run(batches):
        c = codec(tokenizer_path)
        f = c.decode if joined else c.text
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def bpe_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, text_sha256 of every whole text.

    ``decoded_sha256`` is of the pieces joined by spaces, ``text_sha256`` of the running
    text. The digests are fed part by part, so neither the ids nor the decoded text of
    a long document is held whole. Null and empty texts have no ids and the
    digest of nothing. Rows stay as many as they are, ids null or repeated too.
    """

    def run(batches):
        c = codec(tokenizer_path)
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                n, *digests = zip(*map(c.digests, texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in digests]], names=[id_col, "n_tokens", *names])

    names = ("ids_sha256", "decoded_sha256", "text_sha256")
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, {', '.join(f'{x} string' for x in names)}"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
