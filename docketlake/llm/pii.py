"""Personal data: base patterns plus a semi-Markov conditional random field.

The base finds emails, IPv4 addresses, payment cards and international phone
numbers by fixed patterns, each in time linear in the text. A semi-Markov
conditional random field then scores whole candidate segments beside them: runs of
digits with separators between, and names and domains around a written-out "at".
A segment has at most ``LONGEST`` tokens and lies in one line. Its features are those
of the whole span (digits, checksum, form, separators, what stands beside it), made
for all segments of a stretch at once from prefix sums, and one dynamic program
chooses boundaries and kinds jointly. What it finds is added as ``email_like``,
``ip_like``, ``card_like`` and ``phone_like``.

The field is trained in numpy on generated texts of known spans (written-out emails
and addresses, national phone numbers, cards in unusual forms, lists of them) and of
what looks like them (time stamps, logs, decimals, tables, keys, dates, amounts) with
a fixed seed; no document takes part.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.common import releasing, text_slices

KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"{k}_like" for k in KINDS)
_ORDER = {k: n for n, k in enumerate(KINDS + ADDED)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
_ANY = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        if n % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = 0
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append(("email", start, end))
        last = end or at + 1  # what lies before a failed @ can't reach over it
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = _emails(text) if "@" in text else []
    if _ANY.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


# --- candidate segments ------------------------------------------------------

LONGEST = 20  # tokens in a segment: runs of digits, words and single other characters
SPAN, OVER = 1 << 18, 512  # characters whose candidates are held at once; what is read anew where no line ends
_LOOK = re.compile(r"[0-9](?:[ ()\[\].-]{0,5}[0-9]){6}|[0-9]{1,3}(?:(?: ?\[\.\] ?| \. )[0-9]{1,3}){3}|@|[\[(] ?(?:at|AT) ?[\])]")

#: what may stand between two runs of digits of one segment
_SEPARATORS = (" ", "-", ".", ") ", ")", " (", "(", " - ", "[.]", " . ", " [.] ", ")-", "/")
_CHARS = " -.()[]/"
_WRITTEN = (9, 10, 11)  # separators that write out a dot
_OPENS, _CLOSES = (6, 7), (4, 5, 12)
_WIDEST = max(map(len, _SEPARATORS))
_CHAR_CLASS = np.zeros(128, np.int64)
for _n, _c in enumerate(_CHARS, 1):
    _CHAR_CLASS[ord(_c)] = _n
_BY_CODE = np.zeros(9**_WIDEST, np.int64)
for _n, _s in enumerate(_SEPARATORS, 1):
    _BY_CODE[sum((_CHARS.index(_c) + 1) * 9**_k for _k, _c in enumerate(_s))] = _n

#: classes of the characters beside a segment
_BESIDE = np.full(128, 1, np.int64)
for _n, _group in enumerate((" \t\n\r", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_", ".", ",;", ":", "/", "-", "$#%=*+<>", "\"'", "([{", ")]}", "@"), 2):
    for _c in _group:
        _BESIDE[ord(_c)] = _n
_SIDES, _SIDE_OF = 16, _BESIDE.tolist()

_AT = re.compile(r" ?[\[(] ?(?:at|AT) ?[\])] ?| ?@ ?")
_DOT = r"(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?)"
_LABELS = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_NEXT = re.compile(rf"{_DOT}([A-Za-z0-9-]+)")
_LOCAL_END = re.compile(r"[A-Za-z0-9%+-](?:[A-Za-z0-9._%+-]*)\Z")

#: columns of a segment's features and the number of values of each
_COLUMNS = {
    "digits": 26, "runs": 12, "opening": 4, "shape": 1 << 12, "quad": 4, "luhn": 3, "issuer": 2, "kinds": 1 << 6, "left": _SIDES, "right": _SIDES,
    "left run": 14 * 10, "right run": 14 * 10, "longest": 12, "shortest": 12, "first": 10, "ends": 12 * 12, "equal": 2,
    "at": 12, "dots": 4, "labels": 6, "top": 12, "whole": 4, "name": 8, "beside": _SIDES * _SIDES,
}
_FIRST = dict(zip(_COLUMNS, np.cumsum([1, *_COLUMNS.values()])[:-1].tolist()))  # feature 0 is none
N_FEATURES = 1 + sum(_COLUMNS.values())
_NUMBER_COLUMNS = list(_COLUMNS)[:17]
_WIDTH = len(_NUMBER_COLUMNS)

Candidates = tuple[np.ndarray, np.ndarray, np.ndarray]  # starts, ends, features (rows x _WIDTH)


def _beside(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes of the characters at these places; outside the text: as white space."""
    inside = (at >= 0) & (at < len(codes))
    c = codes[np.where(inside, at, 0)] if len(codes) else np.zeros(len(at), np.int64)
    return np.where(inside, _BESIDE[np.minimum(c, 127)] * (c < 128), 2)


def _numbers(codes: np.ndarray, a: int, b: int) -> Candidates:
    """Segments of runs of digits of a stretch, with the features of the whole segment."""
    digit = (codes[a:b] >= 48) & (codes[a:b] <= 57)
    edges = np.flatnonzero(np.diff(digit, prepend=False, append=False))
    s, e = a + edges[::2], a + edges[1::2]
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, _WIDTH), np.int64)
    if not len(s):
        return none
    size = e - s
    d = codes[a:b][digit].astype(np.int64) - 48
    first = np.concatenate([[0], np.cumsum(size)])  # digits before each run
    gap = np.concatenate([s[1:] - e[:-1], [99]])
    code, fits = np.zeros(len(s), np.int64), gap <= _WIDEST
    for k in range(_WIDEST):
        at = e + k
        inside = fits & (k < gap)
        c = codes[np.where(inside, at, 0)]
        kind = _CHAR_CLASS[np.minimum(c, 127)] * (c < 128)
        fits &= ~inside | (kind > 0)
        code += np.where(inside, kind * 9**k, 0)
    sep = np.where(fits, _BY_CODE[np.where(fits, code, 0)], 0)  # 0: no segment goes on here
    low = np.minimum(size, 9)
    value = np.zeros(len(s), np.int64)
    for k in range(3):
        value = np.where(size > k, value * 10 + d[np.minimum(first[:-1] + k, len(d) - 1)], value)
    bad = np.concatenate([[0], np.cumsum((size > 3) | (value > 255))])
    g = np.arange(len(d)) % 2
    twice = 2 * d - 9 * (d > 4)
    sums = [np.concatenate([[0], np.cumsum(np.where(g == p, d, twice))]) for p in (0, 1)]
    is_before = lambda char, far: (s - far >= a) & (codes[np.maximum(s - far, 0)] == ord(char))
    paren, plus, plus_paren = is_before("(", 1), is_before("+", 1), is_before("+", 2)
    bits = np.array([0, *(sum(1 << k for k, c in enumerate(" -.([/") if c in x.replace(")", "(")) for x in _SEPARATORS)])
    written = np.isin(sep, _WRITTEN)
    unclosed = np.isin(sep, _CLOSES).astype(np.int64) - np.isin(sep, _OPENS)
    before = np.concatenate([[0], sep[:-1]]) * 10 + np.concatenate([[0], low[:-1]]) * np.concatenate([[0], sep[:-1] > 0])
    after = sep * 10 + np.concatenate([low[1:], [0]]) * (sep > 0)
    n = len(s)
    shape, mask, tokens, most, least = low.copy(), np.zeros(n, np.int64), np.ones(n, np.int64), size.copy(), size.copy()
    needs, quads, joined = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    out: list[Candidates] = []
    for m in range(1, LONGEST // 2 + 1):
        r = np.arange(n - m + 1)
        if not len(r):
            break
        if m > 1:
            q = r + m - 2  # the separator before the run that is added
            shape, mask, tokens = shape[r] * 1000003 + sep[q] * 1009 + low[q + 1], mask[r] | bits[sep[q]], tokens[r] + gap[q] + 1
            most, least = np.maximum(most[r], size[q + 1]), np.minimum(least[r], size[q + 1])
            needs, quads, joined = needs[r] + unclosed[q], quads[r] + written[q], joined[r] & (sep[q] > 0)
        total = first[r + m] - first[r]
        quad = (m == 4) & (quads == 3)
        opened = (needs == 1) & paren[r]  # an opening parenthesis before the first run is taken where one is closed
        signed = np.where(opened, plus_paren[r], plus[r])
        ok = joined & (tokens + opened + signed <= LONGEST) & ((needs == 0) | opened) & ((total >= 7) & (total <= 24) | quad)
        keep = np.flatnonzero(ok)
        if not len(keep):
            continue
        r = r[keep]
        last = first[r + m] - 1
        check = np.where(last % 2 == 0, sums[0][last + 1] - sums[0][first[r]], sums[1][last + 1] - sums[1][first[r]]) % 10 == 0
        t, opening = total[keep], opened[keep] + 2 * signed[keep]
        start, end = s[r] - opened[keep] - signed[keep], e[r + m - 1]
        values = (
            np.minimum(t, 25), np.full(len(r), m), opening, (shape[keep] * 7919 + opening) % (1 << 12), np.where(quad[keep], np.where(bad[r + 4 if m == 4 else r] == bad[r], 1, 2), 0),
            np.where(t >= 13, np.where(check, 1, 2), 0), (d[first[r]] >= 3) & (d[first[r]] <= 6) & (t >= 16) & (t <= 19), mask[keep], _beside(codes, start - 1), _beside(codes, end),
            before[r], after[r + m - 1], np.minimum(most[keep], 11), np.minimum(least[keep], 11), d[first[r]], np.minimum(size[r], 11) * 12 + np.minimum(size[r + m - 1], 11), most[keep] == least[keep],
        )
        rows = np.stack([np.asarray(v, np.int64) + _FIRST[c] for c, v in zip(_NUMBER_COLUMNS, values)], axis=1)
        out.append((start, end, rows))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else none


def _side(text: str, at: int) -> int:
    c = ord(text[at]) if 0 <= at < len(text) else 32
    return _SIDE_OF[c] if c < 128 else 0


def _addresses(text: str, a: int, b: int, taken: "Taken") -> Candidates:
    """Segments around marks of "at": from the name before to each part of the domain behind."""
    starts, ends, rows = [], [], []
    for m in _AT.finditer(text, a, b):
        if taken.meets(m.start(), m.end()):
            continue
        labels = _LABELS.match(text, m.end(), min(b, m.end() + 300))
        if not labels:
            continue
        name = _LOCAL_END.search(text, max(a, m.start() - 80), m.start())
        if not name:
            continue
        mark = m[0].strip()
        style = (mark == "@") + 2 * (m[0][0] == " ") + 4 * (m[0][-1] == " ")
        stops = [(x.end(), x[1]) for x in _NEXT.finditer(text, m.end(), labels.end())]
        whole = name.start()
        cuts = [whole, *(k + 1 for k in range(whole, m.start() - 1) if text[k] == "." and text[k + 1] not in "._")][-3:]
        for start in {whole, *cuts}:
            for n, (end, top) in enumerate(stops[: LONGEST // 2]):
                plain = "(" not in text[m.end() : end] and "[" not in text[m.end() : end]
                local = text[start : m.start()]
                values = {
                    "at": style, "dots": int(plain), "labels": min(n, 5), "top": min(len(top), 10) if top.isalpha() else 11, "whole": (start == whole) + 2 * (end == labels.end()),
                    "name": any(c.isalpha() for c in local) + 2 * ("." in local) + 4 * (len(local) > 1),
                    "beside": _side(text, start - 1) * _SIDES + _side(text, end),
                }
                row = [v + _FIRST[c] for c, v in values.items()]
                starts.append(start)
                ends.append(end)
                rows.append(row + [0] * (_WIDTH - len(row)))
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(rows, np.int64).reshape(-1, _WIDTH)


class Taken:
    """Stretches of a text that are spans already; no candidate may meet them."""

    def __init__(self, spans: list[Span]):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda x: x[1]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def within(self, a: int, b: int) -> "Taken":
        """The stretches that meet a part of the text, counted from its start."""
        i, j = bisect_right(self.ends, a), bisect_left(self.starts, b)
        out = Taken([])
        out.starts, out.ends = [x - a for x in self.starts[i:j]], [x - a for x in self.ends[i:j]]
        return out

    def meets(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.ends) and self.starts[k] < b

    def free(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which candidates meet none of the stretches."""
        k = np.searchsorted(self.ends, start, "right")
        return np.array([*self.starts, np.iinfo(np.int64).max])[k] >= end


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def candidates(text: str, a: int, b: int, taken: Taken) -> Candidates:
    """The candidate segments of a stretch that meet no span taken, by end, then start; none crosses a line end."""
    lo = max(0, a - 2)
    part = text[lo : b + 1]
    there = taken.within(lo, b + 1)
    found = _numbers(code_points(part), a - lo, b - lo), _addresses(part, a - lo, b - lo, there)
    start, end, rows = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, end))
    order = order[there.free(start[order], end[order])]
    return start[order] + lo, end[order] + lo, rows[order]


# --- the semi-Markov field -------------------------------------------------


class SemiMarkovField:
    """Weights: kinds x features for segments, kinds x kinds for neighbours.

    Kind 0 is outside. A segmentation's score is the sum of its segments' scores and of
    the weights between neighbours; what lies outside scores 0, however long.
    """

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Candidates x kinds."""
        out = np.zeros((len(rows), len(self.weights)))
        w = np.ascontiguousarray(self.weights.T)
        for c in range(rows.shape[1]):
            out += w[rows[:, c]]
        return out

    def decode(self, found: Candidates) -> list[Span]:
        """The best segmentation with these candidates: its spans by start."""
        start, end, rows = found
        if not len(start):
            return []
        own, t = self.scores(rows), self.trans
        # what a segment can gain at most beside its own score; without a gain it is never part of the best
        gain = (t[:, 1:] - t[:, :1]).max(0) + np.maximum((t[1:, :] - t[:1, :]).max(1), 0)
        able = own + gain > 0
        some = np.flatnonzero(able.any(1))
        if not len(some):
            return []
        some = some[np.lexsort((end[some], start[some]))]
        a, b = start[some], end[some]
        # segments that touch no other are decided alone: what lies between groups is outside
        first = np.flatnonzero(np.concatenate([[True], a[1:] > np.maximum.accumulate(b)[:-1]]))
        size = np.diff([*first, len(some)])
        alone = some[first[:-1][size[:-1] == 1]]
        value = np.where(able[alone], own[alone] + t[0, 1:] + t[1:, 0], -np.inf)
        z = value.argmax(1)
        taken = value[np.arange(len(alone)), z] > 0
        out = [(KINDS[k], x, y) for k, x, y in zip(z[taken].tolist(), start[alone][taken].tolist(), end[alone][taken].tolist())]
        for n, m in zip(first.tolist(), size.tolist()):
            if m > 1 or n == first[-1]:
                group = some[n : n + m]
                group = group[np.argsort(end[group], kind="stable")]
                out += self._best(start[group], end[group], own[group], able[group], bool(end[group].max() == end[-1]))
        return sorted(out, key=lambda x: x[1])

    def _best(self, start: np.ndarray, end: np.ndarray, own: np.ndarray, able: np.ndarray, last: bool) -> list[Span]:
        """The best segmentation of one group, by end; outside goes on behind it unless it is the last of all."""
        t = self.trans
        nodes = np.unique(np.concatenate([start, end]))
        begin, stop = np.searchsorted(nodes, start).tolist(), np.searchsorted(nodes, end).tolist()
        arcs = [[(z, v) for z, (v, a) in enumerate(zip(*x), 1) if a] for x in zip(own.tolist(), able.tolist())]
        k, none = len(t), -float("inf")
        into = t.T.tolist()
        best = [0.0] + [none] * (k - 1)
        reach: list[list[tuple[float, int]]] = []  # by node and kind: the best score of going on with it, and the kind before
        back: list[list] = []
        at = 0
        for j in range(len(nodes)):
            came: list = [None] * k
            if j:
                value, before = reach[j - 1][0]
                best = [value] + [none] * (k - 1)
                came[0] = (j - 1, before)
                while at < len(stop) and stop[at] == j:
                    there = reach[begin[at]]
                    for z, value in arcs[at]:
                        if there[z][0] + value > best[z]:
                            best[z], came[z] = there[z][0] + value, (begin[at], there[z][1])
                    at += 1
            back.append(came)
            live = [y for y in range(k) if best[y] > none]
            if len(live) == 1:  # outside alone
                reach.append([(best[0] + x[0], 0) for x in into])
            else:
                reach.append([max((best[y] + x[y], -y) for y in live) for x in into])
                reach[-1] = [(v, -y) for v, y in reach[-1]]
        if not last:
            best = [x + y for x, y in zip(best, t[:, 0].tolist())]
        out, j, y = [], len(nodes) - 1, best.index(max(best))
        while j > 0:
            i, before = back[j][y]
            if y:
                out.append((KINDS[y - 1], int(nodes[i]), int(nodes[j])))
            j, y = i, before
        return out[::-1]

    def gradient(self, found: Candidates, gold: list[Span]):
        """Log-likelihood of the gold segmentation and its gradients, or None where a gold span is no candidate."""
        start, end, rows = found
        k = len(self.trans)
        own = self.scores(rows)
        places = {(int(a), int(b)): n for n, (a, b) in enumerate(zip(start, end))}
        if any((a, b) not in places for _, a, b in gold):
            return None
        nodes = np.unique(np.concatenate([start, end]))
        begin, stop = np.searchsorted(nodes, start).tolist(), np.searchsorted(nodes, end).tolist()
        n, t = len(nodes), self.trans
        alpha, beta, into = np.full((n, k), -np.inf), np.full((n, k), -np.inf), np.full((n, k), -np.inf)
        arcs: list[list[int]] = [[] for _ in range(n)]
        for c, j in enumerate(stop):
            arcs[j].append(c)
        alpha[0, 0], beta[-1] = 0.0, 0.0
        for j in range(n):
            if j:
                alpha[j, 0] = into[j - 1, 0]
                for c in arcs[j]:
                    alpha[j, 1:] = np.logaddexp(alpha[j, 1:], into[begin[c], 1:] + own[c])
            into[j] = np.logaddexp.reduce(alpha[j][:, None] + t, axis=0)
        total = np.logaddexp.reduce(alpha[-1])
        gw, gt = np.zeros_like(self.weights), np.zeros_like(t)
        for j in range(n - 1, 0, -1):
            tail = np.full((len(arcs[j]) + 1, k), -np.inf)
            tail[0, 0] = beta[j, 0]
            for x, c in enumerate(arcs[j], 1):
                tail[x, 1:] = own[c] + beta[j, 1:]
            for x, i in enumerate([j - 1, *(begin[c] for c in arcs[j])]):
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(t + tail[x][None, :], axis=1))
                p = np.exp(alpha[i][:, None] + t + tail[x][None, :] - total)
                gt -= p
                if x:
                    np.add.at(gw.T, rows[arcs[j][x - 1]], -p.sum(0)[None, 1:])
        score, before, at = 0.0, 0, 0
        for kind, a, b in sorted(gold, key=lambda x: x[1]):
            z, i, j = KINDS.index(kind) + 1, int(np.searchsorted(nodes, a)), int(np.searchsorted(nodes, b))
            if i > at:
                score += t[before, 0]
                gt[before, 0] += 1
                gt[0, 0] += i - at - 1
                before = 0
            score += t[before, z] + own[places[a, b], z - 1]
            gt[before, z] += 1
            np.add.at(gw[z - 1], rows[places[a, b]], 1.0)
            before, at = z, j
        if n - 1 > at:
            score += t[before, 0]
            gt[before, 0] += 1
        gt[0, 0] = 0.0  # what is outside scores 0
        gw[:, 0] = 0.0
        return score - total, gw, gt


# --- training ------------------------------------------------------------------


class _Examples:
    """Generated texts with known spans, and with what looks like them."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def d(self, k: int) -> str:
        return "".join(self.r.choices("0123456789", k=k))

    def word(self) -> str:
        return "".join(self.r.choices("abcdefghilmnoprstu", k=self.r.randint(2, 8)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def card(self) -> str:
        r = self.r
        groups = r.choice(((4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5)))
        x = r.choice("3456") + self.d(sum(groups) - 2)
        x += next(c for c in "0123456789" if luhn(x + c))
        sep = r.choice((".", " - ", "/", " ", "-") if len(groups) == 3 else (".", ".", " - ", "/"))
        ends = [sum(groups[:k]) for k in range(len(groups) + 1)]
        return sep.join(x[i:j] for i, j in zip(ends, ends[1:]))

    def phone(self) -> str:
        r, (a, b, c) = self.r, (self.d(3), self.d(3), self.d(4))
        pairs = " ".join(self.d(2) for _ in range(r.randint(3, 6)))
        return r.choice((
            f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"0{self.d(2)} {c} {self.d(4)}", f"0{self.d(3)} {b}{c}",
            f"(0{self.d(2)}) {pairs}", f"(0{self.d(3)}) {b} {self.d(r.randint(2, 5))}", f"0{self.d(1)} {self.d(2)} {self.d(2)} {self.d(2)} {self.d(2)}", f"0{self.d(2)} {pairs}", f"0{self.d(3)}/{self.d(r.randint(5, 8))}", f"0{self.d(2)}-{self.d(r.randint(6, 8))}",
        ))

    def email(self) -> str:
        r = self.r
        at = r.choice((" (at) ", "(at)", " [at] ", "[at]", " @ ", "@ ", " @"))
        dot = "." if r.random() < 0.5 or "@" in at else r.choice((" (dot) ", "[dot]", "(dot)", " [dot] "))
        name = self.word() + r.choice(("", "." + self.word(), self.d(2), "_" + self.word()))
        host = self.word() + r.choice(("", self.d(1), dot + self.word()))
        return f"{name}{at}{host}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'io', 'info'))}"

    def ip(self) -> str:
        top = self.r.choice((9, 99, 255, 255))
        return self.r.choice(("[.]", " . ", " [.] ")).join(str(self.r.randint(0, top)) for _ in range(4))

    def no_ip(self) -> str:
        """Four written-out parts of which one is over 255."""
        parts = [self.r.randint(0, self.r.choice((9, 99, 255))) for _ in range(4)]
        parts[self.r.randrange(4)] = self.r.randint(256, 999)
        return self.r.choice(("[.]", " . ", " [.] ")).join(map(str, parts))

    def date(self) -> str:
        r = self.r
        y, m, d = r.randint(1950, 2035), r.randint(1, 12), r.randint(1, 31)
        return r.choice((f"{y}-{m:02}-{d:02}", f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{d:02}/{m:02}/{y}", f"{y}/{m:02}/{d:02}", f"{y}{m:02}{d:02}", f"{d} {m} {y}"))

    def time(self) -> str:
        r = self.r
        return f"{r.randint(0, 23):02}:{r.randint(0, 59):02}" + r.choice(("", f":{self.d(2)}", f":{self.d(2)}.{self.d(3)}", f":{self.d(2)},{self.d(3)}", f":{self.d(2)}Z"))

    def number(self) -> str:
        r = self.r
        return r.choice((f"{r.randint(0, 999)}.{self.d(r.randint(1, 7))}", f"0.{self.d(6)}", f"-{r.randint(0, 99)}.{self.d(4)}", self.d(r.randint(1, 8)), f"{r.randint(1, 999)},{self.d(3)},{self.d(3)}.{self.d(2)}", f"{r.randint(1, 99)} {self.d(3)} {self.d(3)}", f"{r.random():.3e}"))

    def junk(self) -> str:
        r = self.r
        x = self.d(16)
        bad = x if not luhn(x) else x[:-1] + str((int(x[-1]) + 1) % 10)
        return r.choice((
            f'token = "{"".join(r.choices("0123456789abcdef", k=40))}"', self.date(), f"{self.date()} {self.time()}", f"{self.date()}T{self.time()}", f"{self.date()} - {self.date()}", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", self.d(8), self.d(r.randint(7, 14)),
            f"{self.d(3)}.{self.d(6)}", f"{self.d(4)} {self.d(4)}", bad, ".".join(bad[k : k + 4] for k in (0, 4, 8, 12)), f"{self.word()} @ {self.word()}", f"{self.d(20)}{self.d(8)}", self.no_ip(), self.no_ip(),
            f"no. {self.d(7)}", f"{self.word()}@{self.word()}", f"0x{self.d(8)}ff", f"$ {self.d(3)},{self.d(3)},{self.d(3)}", f"{self.d(1)}.{self.d(2)}.{self.d(5)}", f"({self.word()}) at {self.word()}", f"978-{self.d(1)}-{self.d(2)}-{self.d(6)}-{self.d(1)}",
            f"{self.number()} {self.number()}", f"{self.number()}, {self.number()}, {self.number()}", f"order {self.d(8)} shipped {self.date()} {self.time()}", f"version {self.d(1)}.{self.d(2)}.{self.d(1)} of {self.date()}", f"section {self.d(1)} . {self.d(1)} . {self.d(1)}", f"{self.d(1)}. {self.d(1)}. {self.d(1)}. {self.d(1)}", f"{self.d(3)}-{self.d(4)} of {self.d(4)}",
            f"{self.word()} (at) {self.word()}", f"rate {self.number()} {self.number()} per day", f"{self.d(2)} {self.d(2)} {self.d(2)} {self.d(2)} {self.d(2)}", f"{r.randint(1, 9)} {self.d(3)} {self.d(3)} {self.d(3)}", f"({self.date()}) {self.d(4)}", f"{self.d(5)}-{self.d(4)} {self.d(5)}-{self.d(4)}",
        ))

    def log(self) -> str:
        r = self.r
        when = r.choice((f"[{self.d(2)}/{self.word()[:3].title()}/{r.randint(1990, 2030)}:{self.time()} +{self.d(4)}]", f"{self.date()} {self.time()}", f"{self.date()}T{self.time()}"))
        what = r.choice((f'"GET /{self.word()}/{self.d(3)} HTTP/1.{r.randint(0, 1)}" {r.choice((200, 304, 404, 500))} {self.d(r.randint(1, 6))}', f"INFO {self.word()}[{self.d(5)}]: {self.words(2, 5)} {self.number()} ms", f"pid={self.d(5)} code={self.d(3)} {self.number()} {self.number()} {self.word()}"))
        return r.choice((f"{'.'.join(str(r.randint(0, 255)) for _ in range(4))} - - {when} {what}", f"{when} {what}", f"{what} {when}"))

    def lines(self) -> str:
        r = self.r
        n, sep = r.randint(2, 5), r.choice((" ", "  ", ", ", "\t", "; ", " | "))
        kind = r.choice((self.log, lambda: sep.join(self.number() for _ in range(n)), lambda: sep.join(f"{r.random():.{r.randint(3, 6)}f}" for _ in range(n)), lambda: sep.join(self.d(r.randint(1, 6)) for _ in range(n + 3)), lambda: f"{self.date()} {self.time()}{sep}{self.number()}{sep}{self.d(4)}", lambda: sep.join(self.date() for _ in range(n))))
        return r.choice(("\n", "\n", " ")).join(kind() for _ in range(r.randint(2, 6)))

    def example(self) -> tuple[str, list[Span]]:
        r = self.r
        makers = {"email": self.email, "ip": self.ip, "card": self.card, "phone": self.phone}
        text, gold = self.words(0, 4) + r.choice((" ", "\n", ": ")), []

        def put(kind: str) -> None:
            nonlocal text
            item = makers[kind]()
            gold.append((kind, len(text), len(text) + len(item)))
            text += item

        for _ in range(r.randint(1, 3)):
            what = r.random()
            if what < 0.4:
                put(r.choice(KINDS))
            elif what < 0.6:
                kind, sep = r.choice(("phone", "phone", "phone", "card", "ip", "email")), r.choice((" ", ", ", "; ", "\n", " / ", " or ", " - ", "  "))
                if kind in ("ip", "email") or sep == " - " and kind == "card":
                    sep = "\n"
                alike = r.getstate() if r.random() < 0.6 else None
                for k in range(r.randint(2, 5)):
                    text += sep if k else ""
                    if alike is not None and kind == "phone":
                        form = re.sub("[0-9]", "d", makers[kind]()) if not k else form  # one form a list
                        item = "".join(r.choice("0123456789") if c == "d" else c for c in form)
                        item = re.sub("^([(]?)[0-9]", r"\g<1>0", item) if " " in form and form[0] != "(" else item
                        gold.append((kind, len(text), len(text) + len(item)))
                        text += item
                    else:
                        put(kind)
            elif what < 0.8:
                text += self.junk()
            else:
                text += self.lines()
            text += r.choice((" ", ". ", ", ", "\n", ") ")) + self.words(1, 8) + r.choice((" ", "\n", ": ", " ("))
        taken = Taken(base_spans(text))
        return text, [x for x in gold if not taken.meets(x[1], x[2])]


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Generated texts and the spans in them that the base patterns leave."""
    made = _Examples(seed)
    return [made.example() for _ in range(n)]


@lru_cache(maxsize=1)
def trained_field(n: int = 900, epochs: int = 4, seed: int = 11) -> SemiMarkovField:
    """The field after some epochs of AdaGrad on the conditional likelihood of generated texts."""
    k = len(KINDS)
    field = SemiMarkovField(np.zeros((k, N_FEATURES)), np.zeros((k + 1, k + 1)))
    field.weights[:, _FIRST["digits"] : _FIRST["runs"]] = -1.0
    field.weights[:, _FIRST["at"] : _FIRST["dots"]] = -1.0
    data = [(candidates(t, 0, len(t), Taken(base_spans(t))), gold) for t, gold in examples(n, seed)]
    data = [x for x in data if len(x[0][0])]
    sw, st, order = np.full_like(field.weights, 1e-2), np.full_like(field.trans, 1e-2), random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for found, gold in data:
            if (got := field.gradient(found, gold)) is None:
                continue
            _, gw, gt = got
            hit = np.unique(found[2])
            gw = gw[:, hit] - 1e-4 * field.weights[:, hit]
            sw[:, hit] += gw * gw
            st += gt * gt
            field.weights[:, hit] += 0.4 * gw / np.sqrt(sw[:, hit])
            field.trans += 0.1 * gt / np.sqrt(st)
    field.weights[:, 0] = field.trans[0, 0] = 0.0
    return field


# --- spans of whole texts ---------------------------------------------------------


def field_spans(text: str, field: SemiMarkovField, taken: Taken) -> list[Span]:
    """The field's spans in a text of any length, by start, beside those taken.

    Stretches end at line ends, which no segment crosses. Where a stretch has none, its
    last part is decided anew with what follows.
    """
    out: list[Span] = []
    a, n = 0, len(text)
    while a < n:
        b = min(n, a + SPAN)
        cut = b if b == n else text.rfind("\n", a + SPAN // 2, b) + 1
        found = field.decode(candidates(text, a, cut or b, taken)) if _LOOK.search(text, a, cut or b) else []
        if not cut:
            limit = b - OVER
            cut = min([x[1] for x in found if x[2] > limit], default=limit)
            found = [x for x in found if x[2] <= limit]
            floor = max(cut - OVER // 2, found[-1][2] if found else 0)
            while cut > floor and text[cut - 1].isalnum():
                cut -= 1
        out += found
        a = cut
    return out


def find_spans(text: str, field: SemiMarkovField) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): what the field finds beside the base is added."""
    base = base_spans(text)
    added = [(f"{k}_like", a, b) for k, a, b in field_spans(text, field, Taken(base))] if _LOOK.search(text) else []
    return base, sorted(base + added, key=lambda x: (_ORDER[x[0]], x[1]))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlaps merge."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.removesuffix('_like').upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans array<struct<kind, start, end, base>> and redacted text of each row.

    Null and empty texts have no spans. Starts and ends count code points. Rows
    keep their number; ids may be null or repeated.
    """
    field = trained_field()

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                spans, cleaned = [], []
                for x in texts:
                    base, every = find_spans(x, field)
                    held = set(base)
                    spans.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in held} for k, s, e in every])
                    cleaned.append(redact(x, every))
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(spans, kind), pa.array(cleaned, pa.string())], names=[id_col, "spans", "redacted"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, `end`: bigint, base: boolean>>, redacted string"
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(releasing(run), schema)


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind; all columns stay.

    Null texts stay null, texts without spans stay as they are.
    """
    field = trained_field()
    at_text = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch, text_col):
                part = batch.slice(at, len(texts))
                there = part.column(at_text).is_valid().to_pylist()
                clean = [redact(x, find_spans(x, field)[1]) if ok else None for x, ok in zip(texts, there)]
                yield part.set_column(at_text, part.schema.field(at_text), pa.array(clean, part.schema.field(at_text).type))

    return docs.mapInArrow(releasing(run), docs.schema)


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
