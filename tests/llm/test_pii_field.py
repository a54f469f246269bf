"""The semi-Markov field: its program against enumeration, its spans on generated texts, numeric texts left alone, time and memory."""

import random
import time
import tracemalloc

import numpy as np
import pytest

from docketlake.llm import pii


@pytest.fixture(scope="module")
def field():
    return pii.trained_field()


def added(text, field):
    return [(k, text[a:b]) for k, a, b in pii.find_spans(text, field)[1] if k in pii.ADDED]


def segmentations(found, at=0):
    """All lists of candidates with kinds that do not overlap, in order."""
    yield []
    for n, (a, b) in enumerate(zip(found[0].tolist(), found[1].tolist())):
        if a >= at:
            for z in range(len(pii.KINDS)):
                for rest in segmentations(found, b):
                    yield [(n, z), *rest]


def score_of(found, own, trans, chosen):
    total, at, before = 0.0, int(found[0].min()), 0
    for n, z in chosen:
        a, b = int(found[0][n]), int(found[1][n])
        if a > at:
            total, before = total + trans[before, 0], 0
        total, before, at = total + trans[before, z + 1] + own[n, z], z + 1, b
    return total + (trans[before, 0] if at < int(found[1].max()) else 0)


@pytest.mark.parametrize("seed", range(25))
def test_program_is_enumeration(seed):
    r = np.random.default_rng(seed)
    text = ["12 34567 890123", "a.b (at) c.de 1234567", "555-1234 5551234", "(030) 1234567 8", "x(at)y.zz 10[.]0[.]0[.]1"][seed % 5]
    found = pii.candidates(text, 0, len(text), pii.Taken([]))
    assert 0 < len(found[0]) < 12
    random_field = pii.SemiMarkovField(r.normal(0, 0.7, (4, pii.N_FEATURES)), r.normal(0, 1, (5, 5)))
    random_field.trans[0, 0] = 0
    random_field.weights[:, 0] = 0
    own = random_field.scores(found[2])
    every = {tuple(c): score_of(found, own, random_field.trans, c) for c in segmentations(found)}
    best = max(every, key=every.get)
    spans = [(pii.KINDS[z], int(found[0][n]), int(found[1][n])) for n, z in best]
    assert random_field.decode(found) == spans
    values = np.array(list(every.values()))
    total = np.logaddexp.reduce(values)
    got, gw, gt = random_field.gradient(found, spans)
    assert got == pytest.approx(every[best] - total)
    step = 1e-5
    for weights, grad, at in [(random_field.weights, gw, (r.integers(4), int(x))) for x in r.choice(np.unique(found[2][found[2] > 0]), 4)] + [(random_field.trans, gt, (1, 0)), (random_field.trans, gt, (0, 3))]:
        weights[at] += step
        up = random_field.gradient(found, spans)[0]
        weights[at] -= step
        assert (up - got) / step == pytest.approx(grad[at], abs=1e-3)


def test_generated_texts_held_out(field):
    good = total = 0
    for text, gold in pii.examples(300, 4711):
        found = pii.field_spans(text, field, pii.Taken(pii.base_spans(text)))
        good += found == sorted(gold, key=lambda x: x[1])
        total += 1
    assert good / total >= 0.95


def web_log(n, r):
    stamp = lambda: f"[{r.randint(1, 28):02}/Oct/2023:{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02} +0000]"
    return "".join(f'10.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(1, 254)} - - {stamp()} "GET /p/{r.randint(1, 9999)}.html HTTP/1.0" {r.choice((200, 304, 404))} {r.randint(100, 99999)}\n' for _ in range(n))


def numeric_texts():
    r = random.Random(3)
    yield "log", web_log(400, r)
    yield "stamps", "".join(f"2024-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02} step {k} done\n" for k in range(400))
    yield "floats", " ".join(f"{r.random():.6f}" for _ in range(800))
    yield "float lines", "".join(f"{r.random():.4f} {r.random() * 100:.2f} {r.random():.6f}\n" for _ in range(400))
    yield "table", "".join("\t".join(str(r.randint(0, 9999)) for _ in range(6)) + "\n" for _ in range(300))
    yield "dates", " ".join(f"{r.randint(1950, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" for _ in range(500))


@pytest.mark.parametrize("name,text", list(numeric_texts()))
def test_numeric_texts_are_left_alone(field, name, text):
    assert added(text, field) == []


@pytest.mark.parametrize("text", ["order 12345678 shipped 2024-01-05 14:30:22", "rate 0.938959 0.094080 per day", "The quick brown fox 2024-01-02 and 12 more words, version 1.2.3 at 5 pm.", 'GET / HTTP/1.0" 200 3435', "ISBN 978-3-16-148410-0 of 1998", "lines 10-20, 30-40 and 1,234,567.89 in 2019/2020", "score 1 2 3 4 in order", "me at home (at) last"])
def test_sentences_are_left_alone(field, text):
    assert added(text, field) == []


@pytest.mark.parametrize("text,want", [
    ("call (030) 12 34 56 78 90 12 today", ["(030) 12 34 56 78 90 12"]), ("call (030) 12 34 56 78 now", ["(030) 12 34 56 78"]),
    ("ann.lee (at) mail (dot) org please", ["ann.lee (at) mail (dot) org"]), ("at 4111.1111.1111.1111 it is", ["4111.1111.1111.1111"]),
    ("host 10[.]0[.]0[.]1 is up", ["10[.]0[.]0[.]1"]), ("(842-723-6178) or else", ["842-723-6178"]),
])
def test_spans_are_whole(field, text, want):
    assert [s for _, s in added(text, field)] == want


@pytest.mark.parametrize("sep", [" ", ", ", "; ", "\n", " / "])
def test_each_number_of_a_list_is_its_own(field, sep):
    r = random.Random(9)
    numbers = [f"{r.randint(200, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}" for _ in range(200)]
    assert added(sep.join(numbers), field) == [("phone_like", n) for n in numbers]


def test_base_spans_stay(field):
    r = random.Random(12)
    for _ in range(600):
        text = "".join(r.choice(["a.", "@", "-", "+", "12", "345 ", "(at)", "x.de ", "\n", "4111 1111 1111 1111", "é", "[.]", "9"]) for _ in range(r.randint(0, 30)))
        base, every = pii.find_spans(text, field)
        assert base == pii.base_spans(text) and set(base) <= set(every)
        taken = sorted((a, b) for _, a, b in every if (_, a, b) not in base)
        assert all(x[1] <= y[0] for x, y in zip(taken, taken[1:])) and not any(pii.Taken(base).meets(a, b) for a, b in taken)


def megabytes():
    r = random.Random(1)
    fill = lambda make: "".join(make() for _ in range(1_100_000 // len(make())))[:1_000_000]
    yield "web log", web_log(11_000, r)[:1_000_000]
    yield "ip addresses", fill(lambda: f"{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)} ")
    yield "written-out ip addresses", fill(lambda: f"{r.randint(10, 99)}[.]{r.randint(10, 99)}[.]{r.randint(10, 99)}[.]{r.randint(10, 99)} ")
    yield "emails", fill(lambda: f"ann{r.randint(100, 999)}@mail.org ")
    yield "written-out emails", fill(lambda: f"ann{r.randint(100, 999)} (at) mail.org ")
    yield "phone numbers", fill(lambda: f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)} ")
    yield "floats", fill(lambda: f"{r.random():.6f} ")
    yield "marks", "a@b " * 250_000
    yield "digits", "1 " * 500_000
    yield "one number", "7" * 1_000_000


@pytest.mark.parametrize("name,text", list(megabytes()))
def test_a_megabyte_takes_little(field, name, text):
    field.decode(pii.candidates("1-2", 0, 3, pii.Taken([])))
    began = time.process_time()
    pii.find_spans(text, field)
    assert time.process_time() - began < 5
    if name in ("web log", "phone numbers", "digits"):
        tracemalloc.start()
        pii.find_spans(text[:400_000], field)
        assert tracemalloc.get_traced_memory()[1] < 300 << 20
        tracemalloc.stop()


def test_stretches_without_a_line_end(field, monkeypatch):
    r = random.Random(4)
    text = " ".join(f"{r.choice(('call ', 'or ', ''))}{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}" for _ in range(300))
    whole = pii.find_spans(text, field)
    monkeypatch.setattr(pii, "SPAN", 1024)
    assert pii.find_spans(text, field) == whole
