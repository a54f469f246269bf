"""Greedy longest-match token counts in linear time.

The vocabulary is a trie with failure links. Each node knows the node that remains
after greedily popping whole tokens off its path and how many tokens that pops, so
one pass over a word adds popped counts and never builds or rescans a piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.bpe import WORDS, BpeModel, byte_alphabet, marked
from docketlake.llm.common import text_slices
from docketlake.llm.subwords import chunks_of, oldest_half, segments


class LongestMatch:
    """Counts the pieces of greedy longest-match segmentation of a word."""

    def __init__(self, tokens: Iterable[str]):
        step: dict[tuple[int, str], int] = {}
        parent, char, final = [0], [""], [False]
        for token in tokens:
            node = 0
            for c in token:
                nxt = step.get((node, c))
                if nxt is None:
                    nxt = step[node, c] = len(parent)
                    parent.append(node)
                    char.append(c)
                    final.append(False)
                node = nxt
            final[node] = bool(node)
        n = len(parent)
        depth = [0] * n
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        #: where a node's path goes on after popping, and the tokens popped; -1: no token fits
        fail, popped = [-1] * n, [0] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if final[v]:
                fail[v], popped[v] = 0, 1
                continue
            u, count = fail[parent[v]], popped[parent[v]]
            while u >= 0 and (u, char[v]) not in step:
                count += popped[u]
                u = fail[u]
            if u >= 0:
                fail[v], popped[v] = step[u, char[v]], count
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: str) -> int:
        """Pieces of ``word``; -1 if greedy matching finds none at some place."""
        step, fail, popped, u, n = self.step, self.fail, self.popped, 0, 0
        for c in word:
            v = step.get((u, c))
            while v is None:
                if u == 0 or fail[u] < 0:
                    return -1
                n += popped[u]
                u = fail[u]
                v = step.get((u, c))
            u = v
        while u:
            if fail[u] < 0:
                return -1
            n += popped[u]
            u = fail[u]
        return n


class TokenCounter:
    """(words, tokens, unknown words) of whole texts, with a bounded memo of chunks.

    A word is a run of letters, a digit or a run of other characters, lower-cased;
    its symbols are its bytes, the last one marked as such. A word that greedy matching can't
    cover counts as one unknown token.
    """

    def __init__(self, path: str, memo: int = 800_000, longest: int = 64):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.ends = bool(suffix)
        self.match = LongestMatch(marked(t.removesuffix(suffix)) if suffix and t.endswith(suffix) and t != suffix else t for t in model["vocab"])
        self.alphabet = byte_alphabet()
        self.memo, self.longest, self.held = memo, longest, {}

    def word(self, word: str) -> str:
        """The byte symbols of a word, the last one marked."""
        symbols = "".join([self.alphabet[b] for b in word.encode("utf-8")])
        return marked(symbols) if self.ends else symbols

    def _chunk(self, chunk: str) -> tuple[int, int, int]:
        words = tokens = unknown = 0
        for m in WORDS.finditer(BpeModel.normalised(self, chunk)):
            n = self.match.count(self.word(m[0]))
            words += 1
            tokens += max(n, 1)
            unknown += n < 0
        return words, tokens, unknown

    def count(self, text: str) -> tuple[int, int, int]:
        words = tokens = unknown = 0
        for segment in segments(text) if len(text) > 1_000_000 else (text,):
            held, chunks = self.held, chunks_of(segment)
            for c in set(chunks).difference(held):
                held[c] = self._chunk(c)
            for a, b, c in map(held.__getitem__, chunks):
                words += a
                tokens += b
                unknown += c
            if len(held) > self.memo:
                self.held = oldest_half(held)
        return words, tokens, unknown


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_tokens, n_unknown of every whole text; null and empty: zeros.

    Rows stay as many as they are, ids null or repeated too.
    """

    def run(batches):
        c = counter(vocabulary_path)
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                cols = zip(*map(c.count, texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *[pa.array(x, pa.int64()) for x in cols]], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)
