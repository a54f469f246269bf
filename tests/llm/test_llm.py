"""The training-data operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import math
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketlake.llm import bpe, exact_dedup, language_id, lm_scoring, ngram_join, packing, pii, quality, shingles, subwords, token_counts, top_k
from docketlake.llm.queries import OP3_SQL, OP6_SQL, WORD_BPE, oracle_sql, queries

from ..conftest import SF

WIDE = "doc_id long, text string, id long, digest string, n long, key string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """(doc_id, text) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, 1, "x", 2, "k", "en", None, 0) for d, t in rows], WIDE)


def awkward(spark):
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "one two"), (None, "one two"), (6, long), (7, long), (8, long + " end"), (9, "!!! 中文 😀 éÈ"), (9, "!!! 中文 😀 éÈ"), (10, "x" * 5000)]
    return docs_of(spark, rows)


def empty(spark):
    return docs_of(spark, [])


def crc(x, n):
    return zlib.crc32(str(x).encode()) % n


# --- registry ---------------------------------------------------------------------


def test_one_query_for_each_operator():
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in queries()) == 1
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name,sql", [("op3_top_k", OP3_SQL), ("op6_exact_dedup", OP6_SQL)])
def test_same_as_sql(spark, duck, name, sql):
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    got = [tuple(r) for r in queries()[name](spark, SF).select(*columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))


# --- 1: n-gram join -----------------------------------------------------------------


def brute_sets(rows):
    word = re.compile(rb"[^\x20\x09-\x0d]+")
    out = {}
    for d, t in rows:
        w = word.findall((t or "").encode().lower())
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_components(sets):
    up = {d: d for d in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def near_copies(seed, groups, size, r=None):
    r = r or random.Random(seed)
    rows, common = [], [f"c{k}" for k in range(60)]
    for _ in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(3, 120))]
        if r.random() < 0.4:
            base = common[: r.randint(20, 60)] + base[:15]
        for _ in range(r.randint(1, size)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"w{r.randrange(3000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("options", [{}, {"pivots": 1, "rounds": 0}, {"pivots": 1, "rounds": 1}])
def test_components_like_brute_force(spark, options):
    rows = near_copies(5, 25, 8)
    sets = brute_sets(rows)
    got = ngram_join.similar_components(docs_of(spark, rows), **options).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(sets)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(s) for d, s in sets.items()}


def test_near_copies_of_awkward_rows(spark):
    rows = ngram_join.similar_components(awkward(spark)).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert [by[k]["component_id"] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 2, 3, 4, 4, 6, 6, 6, 9]
    assert by[None]["component_id"] is None and by[4]["n_class"] == 3
    kept = ngram_join.keep_one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 9, 9, 10]
    assert ngram_join.similar_components(empty(spark)).count() == 0 and ngram_join.keep_one_of_each(empty(spark)).count() == 0


def test_word_hashes_tell_words_apart():
    a = shingles.word_hashes("Ab aB\tab\nb")
    assert a[0] == a[1] == a[2] != a[3]
    words = [f"w{k}" for k in range(50_000)]
    assert len(set(shingles.word_hashes(" ".join(words)).tolist())) == 50_000
    assert shingles.word_hashes("x y")[1] == shingles.word_hashes("a long text before y")[-1]


# --- 2: packing ----------------------------------------------------------------------


def check_packing(rows, length):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return by


def test_packing_plan():
    r = random.Random(1)
    for _ in range(50):
        length = r.choice((1, 7, 64))
        histogram = {k: r.randint(1, 30) for k in range(1, length + 1) if r.random() < 0.5}
        used = collections.Counter()
        for pattern, n in packing.packing_plan(histogram, length):
            assert sum(size * k for size, k in pattern) <= length and n > 0
            for size, k in pattern:
                used[size] += n * k
        assert used == histogram
    plan = packing.packing_plan({k: 2000 - k // 2 for k in range(1, 2049)}, 2048)
    total = sum(k * (2000 - k // 2) for k in range(1, 2049))
    assert sum(n for _, n in plan) * 2048 < total * 1.01 and len(plan) < 20_000


def test_packing_of_awkward_rows(spark):
    pieces = packing.token_pieces(awkward(spark), WORD_BPE, length=512).cache()
    rows = packing.pack_pieces(pieces, 512, rows_per_bucket=5).collect()
    check_packing(rows, 512)
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append((r["start"], r["ids"]))
        assert len(r["ids"]) == 4 * r["length"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    for r in awkward(spark).collect():
        want = array("I", [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]).tobytes()
        got = sorted(whole[r["doc_id"]])
        if r["doc_id"] == 9:  # the repeated row: both rows are packed
            got = got[::2]
        assert b"".join(x for _, x in got) == want
    assert packing.pack_pieces(packing.token_pieces(empty(spark), WORD_BPE)).count() == 0


# --- 3: top k ----------------------------------------------------------------------------


def test_top_k_by_brute_force(spark):
    r = np.random.default_rng(3)
    m = r.normal(0, 1, (700, 12)) * np.exp(r.normal(0, 1, (700, 1)))
    m[100:160] = m[100]  # ties
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(m)]
    rows += [(900, None), (950, [1.0, None]), (1000, [float("nan")] * 12), (1050, [float("inf")] * 12), (None, [1.0] * 12), (1100, [5.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("x", F.lit(2))
    got = top_k.top_inner_products(df, F.col("vec_id") % 50 == 0, block=64, group=4, head=3).collect()
    full = {k: np.floor(256 * np.array(v + [0.0] * (12 - len(v)))) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(k for k in full if k % 50 == 0):
        best = sorted((-int(full[q] @ v), k) for k, v in full.items() if k != q)[:5]
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    few = spark.createDataFrame([(0, [1.0]), (3, [2.0]), (4, [0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in top_k.top_inner_products(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(3, 131072), (4, 0)]
    assert top_k.top_inner_products(few.limit(0), F.col("vec_id") == 0).count() == 0


# --- 4: BPE ---------------------------------------------------------------------------------

ODD = "abcdeéÉèΣσİIJǰ́̌ \t\n\x1c\x85 'stSTre.,!?123<|endoftext|>ABCDß中文😀‍﻿"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def test_bpe_like_the_library(library):
    r, codec, encoder = random.Random(2), bpe.BpeCodec(WORD_BPE), subwords.ChunkEncoder(WORD_BPE)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["", "a<|endoftext|>b", "a" * 5000, "!" * 5000, "the" * 3000, "".join(r.choice("abcdefghij") for _ in range(9000)), "don't THEY'LL"]
    for text, data in zip(texts, encoder.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids and data == array("I", ids).tobytes()
        shown = library.decode(ids, skip_special_tokens=False)
        assert codec.decode(ids) == shown
        assert codec.digests(text) == (len(ids), *(hashlib.sha256(x).hexdigest() for x in (data, shown.encode(), codec.text(ids).encode())))


def test_decoder_state():
    text = "aé中😀z"
    for size in (1, 2, 3):
        d, data = bpe.TextDecoder(), text.encode()
        assert "".join(d.feed(data[k : k + size]) for k in range(0, len(data), size)) + d.feed(b"", True) == text
    d = bpe.TextDecoder()
    assert d.feed(b"\xe4\xb8") == "" and d.feed(b"", True) == "�"


def test_bpe_of_awkward_rows(spark, library):
    rows = awkward(spark)
    out = bpe.bpe_digests(rows, WORD_BPE).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == sorted((r["doc_id"] or 0, len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows.collect())
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(bpe.bpe_encode(rows, WORD_BPE), WORD_BPE).collect()}
    assert back[4] == "one two" and back[1] == "" and back[9].endswith("éè")
    assert bpe.bpe_digests(empty(spark), WORD_BPE).count() == 0


# --- 5: personal data ----------------------------------------------------------------------------

PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def plain_spans(text):
    out = []
    for kind, p in PATTERNS:
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_like_the_patterns():
    r = random.Random(6)
    for _ in range(8000):
        text = "".join(r.choice("a.@-+1234 5(){}_%é9") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text)


def test_redaction_keeps_the_rest(spark):
    rows = docs_of(spark, [(1, "mail a@b.co and 10.0.0.1!"), (2, None), (3, "")])
    out = {r["doc_id"]: r["text"] for r in pii.redact_pii(rows).collect()}
    assert out == {1: "mail [EMAIL] and [IP]!", 2: None, 3: ""}
    assert pii.redact("abcdef", [("email", 1, 4), ("phone", 2, 5)]) == "a[EMAIL]f"
    spans = pii.span_digests(pii.find_pii(rows)).orderBy("doc_id").collect()
    assert spans[0]["spans"] == "email:5:11,ip:16:24" and spans[0]["n_ip"] == 1
    assert spans[0]["base_sha256"] == hashlib.sha256(b"email:5:11,ip:16:24").hexdigest()
    assert pii.span_digests(pii.find_pii(awkward(spark))).count() == 12 and pii.find_pii(empty(spark)).count() == 0


# --- 6: exact dedup --------------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["min", "max"])
def test_dedup_of_awkward_rows(spark, keep):
    df = awkward(spark)
    rows = df.collect()
    out = exact_dedup.exact_dedup(df, keep=keep, salt_rows=2).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    want = []
    for text, ids in groups.items():
        best = (min if keep == "min" else max)(x for x in ids if x is not None)
        held = False
        for d in sorted(ids, key=lambda x: (x is None, x)):
            kept = d == best and not held
            held |= kept
            want.append((d, best, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    kept = exact_dedup.drop_exact_copies(df, keep=keep)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, _, k, _ in want if k)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0 and exact_dedup.drop_exact_copies(empty(spark)).count() == 0


def test_index_grows_and_compacts(spark):
    index = exact_dedup.DigestIndex(spark, "min", fan_in=2, memtables=2)
    for at in (0, 50, 90):
        rows = spark.range(at, at + 60).select(F.col("id"), exact_dedup.digest_of((F.col("id") % 40).cast("string")).alias("digest"))
        index.flush(rows, "id")
    assert all(len(p) < 2 for p in index.levels.values())
    got = {r["keep_id"]: r["group_size"] for r in index.table().collect()}
    count = collections.Counter(k % 40 for at in (0, 50, 90) for k in range(at, at + 60))
    assert got == dict(count)


# --- 7: quality ------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    scored = queries()["op7_quality"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = [(scored.loc[d, "score"], q) for d, q in zip(labels.doc_id, labels.quality) if crc(d, 3) == 1]
    good = sum((s >= 0.5) == q for s, q in held)
    assert scored.score.between(0, 1).all() and good / len(held) > 0.93


def test_quality_of_awkward_rows(spark):
    rows = awkward(spark)
    net = quality.train_quality(rows, rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    out = quality.score_quality(rows, net).collect()
    assert len(out) == 12 and all(0 <= r["score"] <= 1 for r in out)
    assert quality.keep_quality(rows, net, least=0.0).count() == 12
    none = quality.train_quality(rows, empty(spark).select("doc_id", F.lit(1).alias("quality")))
    assert {r["score"] for r in quality.score_quality(rows, none).collect()} == {0.5}


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        c = quality.chunks(bytes(k % 251 + 1 for k in range(n)))
        seen = np.zeros(max(n, 1), bool)
        for k in range(len(c)):
            seen[k * 448 : k * 448 + 512] = True
        assert seen.all() and c.shape[1] == 512


# --- 8: language -------------------------------------------------------------------------------------


def test_languages_on_held_out_rows(spark):
    out = queries()["op8_language"](spark, "/root/testdata/sf0.01").toPandas()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [(lang[d], p) for d, h, p in zip(out.doc_id, out.held_out, out.lang_pred) if h]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_forward_backward_by_brute_force():
    import itertools

    r = np.random.default_rng(1)
    trans, start = r.normal(size=(3, 3)), r.normal(size=3)
    lens = np.array([5, 3, 3, 1])
    emit = r.normal(size=(lens.sum(), 3))
    post = language_id.forward_backward(emit, lens, trans, start)[0]
    at = 0
    for n in lens:
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = start[path[0]] + sum(emit[at + k, y] for k, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
            for k, y in enumerate(path):
                total[k, y] += math.exp(s)
        assert np.allclose(post[at : at + n], total / total.sum(1, keepdims=True))
        at += n


def test_switching_text_is_labelled_word_by_word(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = language_id.train_languages(docs, train_docs=60)
    one = {r["lang"]: r["text"] for r in docs.filter("n_chars > 600").select("lang", "text").collect()}
    mixed = " ".join(one["en"].split()[:25] + one["de"].split()[:25])
    words = language_id.label_words(docs_of(spark, [(1, mixed)]), field).orderBy("n").collect()
    half = len(language_id.words_of(" ".join(one["en"].split()[:25])))
    assert sum(w["lang"] == ("en" if w["n"] < half else "de") for w in words) / len(words) > 0.85
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify_language(awkward(spark), field).collect()}
    assert out[1] == out[2] == out[3] == "und" and len(out) == 11
    assert language_id.train_languages(empty(spark)) is None
    assert {r["lang_pred"] for r in language_id.identify_language(awkward(spark), None).collect()} == {"und"}


# --- 9: token counts -------------------------------------------------------------------------------------


def greedy(word, vocabulary):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_longest_match_like_greedy():
    r = random.Random(8)
    for _ in range(200):
        vocabulary = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        m = token_counts.LongestMatch(sorted(vocabulary))
        for _ in range(40):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
            assert m.count(word) == greedy(word, vocabulary)


def test_token_counts_of_whole_texts(spark):
    import json

    with open(WORD_BPE) as f:
        vocabulary = set(json.load(f)["model"]["vocab"])
    c = token_counts.counter(WORD_BPE)
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect():
        words = tokens = 0
        for chunk in r["text"].lower().split():
            for m in bpe.WORDS.finditer(chunk):
                s = [c.alphabet[b] for b in m[0].encode()]
                s[-1] += "</w>"
                n = at = 0
                while at < len(s):
                    at = next(e for e in range(len(s), at, -1) if "".join(s[at:e]) in vocabulary)
                    n += 1
                words, tokens = words + 1, tokens + n
        assert c.count(r["text"]) == (words, tokens, 0)
    out = token_counts.token_counts(awkward(spark), WORD_BPE).collect()
    assert len(out) == 12 and all(r["n_tokens"] >= r["n_words"] for r in out)
    assert token_counts.token_counts(empty(spark), WORD_BPE).count() == 0


# --- 10: language model scores ------------------------------------------------------------------------------


def test_lm_base_by_brute_force_and_model_on_held_out(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = {r["doc_id"]: r for r in queries()["op10_lm_scoring"](spark, SF).collect()}
    tokens = {r["doc_id"]: [*r["text"].encode().lower().split(), None] for r in rows}
    count = collections.Counter(w for d, t in tokens.items() if crc(d, 10) for w in t)
    total, distinct = sum(count.values()), len(count)
    for d, t in tokens.items():
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        r = out[d]
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(t) and r["train_tokens"] == total
        assert r["n_known"] == sum(count[w] > 0 for w in t) and r["held_out"] == (crc(d, 10) == 0) and r["score"] < 0


def test_lm_of_awkward_rows(spark):
    out = lm_scoring.lm_scores(awkward(spark), F.col("doc_id") != 9, WORD_BPE, share=0.01).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 12 and by[1]["n_tokens"] == by[2]["n_tokens"] == by[3]["n_tokens"] == 1
    assert by[6]["n_tokens"] == 30_001 and by[9]["n_known"] == 1
    assert lm_scoring.lm_scores(empty(spark), F.col("doc_id") > 0, WORD_BPE).count() == 0


def test_attention_beats_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base = docs.select(F.col("doc_id").alias("id"), (F.crc32(F.col("doc_id").cast("string")) % 10 != 0).alias("learn"), "text")
    rows = lm_scoring.subword_ids(base, WORD_BPE, np.empty(0, np.uint64), np.empty(0), 100_000).select("learn", "ids").cache()
    model, pairs = lm_scoring.learned(rows.filter("learn").select("ids"), 49408, 49406, 49407)
    t = model.tables(pairs)
    held = [lm_scoring._wide(r["ids"]) for r in rows.filter("NOT learn").collect()]
    n = sum(len(x) + 1 for x in held)
    got = lm_scoring.attention_scores(held, t, 49406, 49407).sum() / n
    classes = np.stack([np.bincount(model.classes, x, lm_scoring.CLASSES) for x in pairs]) + 0.1
    classes = np.log(classes / classes.sum(1, keepdims=True))
    share = (pairs.sum(0) + 0.1) / (pairs.sum() + 0.1 * 49408)
    counts = unigram = 0.0
    for x in held:
        flat = np.concatenate([[49406], x, [49407]])
        a, b = model.classes[flat[:-1]], model.classes[flat[1:]]
        counts += (classes[a, b] + t["within"][a, flat[1:]]).sum() / math.log(10)
        unigram += np.log10(share[flat[1:]]).sum()
    t0 = t | {"rows": t["rows"].copy()}
    t0["rows"][:, 2 * lm_scoring.KEY : 2 * lm_scoring.KEY + lm_scoring.WIDTH] = 0
    print(f"attention {got:.3f}, without values {lm_scoring.attention_scores(held, t0, 49406, 49407).sum() / n:.3f}, class counts {counts / n:.3f}, single ids {unigram / n:.3f}")
    assert got > counts / n + 0.1 and got > unigram / n + 0.4


def test_windows_score_each_id_once():
    m = lm_scoring.AttentionModel(40, 38, 39)
    r = np.random.default_rng(0)
    for w in m.p.values():
        w[...] = r.normal(0, 0.3, w.shape)
    t = m.tables(r.integers(0, 9, (lm_scoring.CLASSES, 40)))
    key, width = lm_scoring.KEY, lm_scoring.WIDTH
    t |= zip("qkvx", np.split(t["rows"], [key, 2 * key, 2 * key + width], axis=1))
    window, stride = lm_scoring.WINDOW, lm_scoring.STRIDE
    texts = [r.integers(0, 38, n) for n in (0, 1, window - 2, window - 1, window, window + 1, window + stride - 1, window + stride, 200)]
    together = lm_scoring.attention_scores(texts, t, 38, 39, block=3)
    for x, got in zip(texts, together):
        flat, want = np.concatenate([[38], x, [39]]), 0.0
        for i in range(len(flat) - 1):
            first = 0 if i < window else stride * ((i - window + stride) // stride)
            inp = flat[first : i + 1]
            s = t["k"][inp] @ t["q"][flat[i]] + t["rel"][i - np.arange(first, i + 1)]
            s = np.exp(s - s.max())
            z = np.concatenate([(s / s.sum()) @ t["v"][inp], t["x"][flat[i]]]) @ t["top"] + t["bias"]
            c = t["class"][flat[i + 1]]
            want += z[c] - z.max() - np.log(np.exp(z - z.max()).sum()) + t["within"][t["class"][flat[i]], flat[i + 1]]
        assert got == pytest.approx(want / lm_scoring.LOG10, rel=1e-4)


# --- pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        rows = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(rows) <= set(before)
        if name == "exact_dedup":
            best = {}
            for d, t in before.items():
                best[t] = max(d, best.get(t, d))
            assert set(rows) == set(best.values())
        if name == "ngram_join":
            comps = brute_components(brute_sets(before.items()))
            assert set(rows) == {d for d, c in comps.items() if d == c}
        if name == "pii":
            assert set(rows) == set(before) and not any(pii.base_spans(t) for t in rows.values())
        else:
            assert all(before[d] == t for d, t in rows.items())
        before = rows
    out = p.packing(spark, docs, SF).collect()
    check_packing(out, 2048)
    assert {r["doc_id"] for r in out} == set(before)
