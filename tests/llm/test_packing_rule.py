"""The packing plan against shortest-pack-first, one piece at a time."""

import random
from collections import Counter

from docketlake.llm import packing


def packing_plan(histogram, length):
    """The plan with every length of a pattern written out."""
    return [([size for size, k in pattern for _ in range(k)], n) for pattern, n in packing.packing_plan(histogram, length)]


def one_by_one(histogram, length):
    packs = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            fits = [p for p in packs if length - sum(p) >= size]
            if fits:
                min(fits, key=sum).append(size)
            else:
                packs.append([size])
    return packs


def totals(plan):
    out = Counter()
    for pattern, n in plan:
        out[sum(pattern)] += n
    return out


def test_a_pack_takes_a_length_more_than_once():
    plan = packing_plan({1100: 100_000, 100: 500_000}, 2048)
    assert sum(n for _, n in plan) == 100_000
    assert sum(n * p.count(100) for p, n in plan) == 500_000


def test_fill_like_one_piece_at_a_time():
    r = random.Random(3)
    for _ in range(300):
        length = r.randint(5, 60)
        histogram = {r.randint(1, length): r.randint(1, 12) for _ in range(r.randint(1, 8))}
        plan = packing_plan(histogram, length)
        placed = Counter()
        for pattern, n in plan:
            placed.update({k: c * n for k, c in Counter(pattern).items()})
        assert placed == Counter(histogram)
        assert totals(plan) == totals([(p, 1) for p in one_by_one(histogram, length)])


def test_the_bound_is_reached():
    for histogram, most in (({1500: 1000, 10: 50_000}, 1000), ({1200: 1000, 300: 3000}, 1167), ({1000: 1, 1: 5000}, 3)):
        assert sum(n for _, n in packing_plan(histogram, 2048)) == most


def test_query_ids_and_padding(spark):
    import zlib
    from array import array
    from collections import defaultdict

    from tokenizers import Tokenizer

    from docketlake.llm.queries import WORD_BPE, queries

    from ..conftest import SF

    library = Tokenizer.from_file(WORD_BPE)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries()["op2_packing"](spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for d, rows in pieces.items():
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(array("I", ids[r["start"] : at]).tobytes())
        assert at == len(ids)
    for rows in sequences.values():
        fill = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == fill
            fill += r["length"]
        assert {r["padded_length"] for r in rows} == {fill if bin(fill).count("1") == 1 else 2048}


def test_few_slots_for_many_short_pieces():
    """A long histogram with very many empty texts: runs keep the plan small, chunks keep the tests a piece few."""
    for histogram in ({k: 3 + k % 7 for k in range(1025, 2048)} | {1: 10_000_000}, {k: 1 + 2_000_000 // k**2 for k in range(1, 2049)}, {k: 1000 for k in range(1, 2049)}):
        slots = packing.plan_slots(packing.packing_plan(histogram, 2048), 2048)
        chunks, of = packing.slot_chunks(slots)
        assert len(slots) < 6000
        tests = Counter(size for size, *_ in chunks)
        runs = Counter((slot[0], c) for slot, c in zip(slots, of))
        assert max(tests[size] + runs[size, c] for size, c in runs) <= 100
        for size, n in histogram.items():  # ranks are covered without a gap
            at = 0
            for slot in (x for x in slots if x[0] == size):
                assert slot[1] == at
                at += slot[2] * slot[3]
            assert at == n
            assert [c[2:] for c in chunks if c[0] == size][-1][1] == n


def test_pieces_with_columns_of_the_plan(spark):
    rows = [(k, 0, 1 + k % 5, "b", "s", "r") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, start long, length long, base string, packs string, run string")
    out = packing.pack_pieces(df, 16, rows_per_bucket=7).collect()
    assert len(out) == 300 and out[0].base == "b"
    filled = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 16 and len(filled) == -(-sum(r[2] for r in rows) // 16)
