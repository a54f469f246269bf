"""N-gram Jaccard join with prefix filters under several global token orders.

A text's set holds the hashes of its word shingles. Two sets with Jaccard
similarity of ``percent`` or more (in hundredths) share a token within their prefixes under any
one order of all tokens, so a candidate pair has to share one under each of several
orders. The first order (rarest token first) makes the candidates; hash orders 2
and 3 are intersected with it before a pair's sets are compared in full.

How the work is kept down without losing a link:

* Equal sets form a class; a class is joined once, whatever its rows.
* Repeat filter: if a set of n tokens has a partner, then of its d + k smallest
  tokens in hash order (d = n - ceil(t n), k a tenth of n) a known number occurs in
  a second set too. Those tokens are dealt by hash; sets with too few repeated ones
  can't have a partner and go no further. Tokens travel packed, four bytes each; all
  of a set's tokens count one by one, so a clash can only let a set through. A token
  that a task has met in two sets is counted there and sent on with these two alone,
  so a token in every set makes no large group.
* Links are only needed between sets not yet connected. Rounds of pivots (a few
  sets of each posting list, chosen by hash) connect most of a group with a linear
  number of pairs. The last round compares the pairs of a posting list that are not
  connected yet, so the components are exact; lists are split into bands of set sizes.
* A pair comes from a common token only if it could be the pair's first: what stands
  before it in the first order counts as not shared.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketlake.llm.common import freed_shuffles, integral, releasing, text_slices, written
from docketlake.llm.exact_dedup import block_filter, passing
from docketlake.llm.shingles import mixed, shingle_set

ORDERS = (2, 3)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _set_id(tokens: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty set."""
    return blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def set_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """id, n (set size), set_id (16 bytes, null for the empty set) of every row."""

    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                n, own = [], []
                for x in texts:
                    s = shingle_set(x, words)
                    n.append(len(s))
                    own.append(_set_id(s))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(own, pa.binary())], names=["id", "n", "set_id"])

    return _texts(docs, id_col, text_col).mapInArrow(releasing(run), "id long, n long, set_id binary")


def _least(n: np.ndarray | int, percent: int):
    """ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


def _extra(n):
    return n // 10 + 1


_ID = np.dtype([("a", "<u8"), ("b", "<u8")])
_PACKED = "bucket int, ids binary, counts binary, tokens binary"


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of ``x`` the sorted ``held`` has."""
    return held[np.minimum(np.searchsorted(held, x), len(held) - 1)] == x if len(held) else np.zeros(len(x), bool)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _packed_tokens(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, buckets: int, most: int = 200_000) -> DataFrame:
    """(bucket, ids, counts, tokens): the first tokens of many sets, dealt by hash.

    A row holds what one slice of texts has for a bucket. A token that the task has
    sent with two sets is known as repeated (up to ``most`` tokens are held): it is
    counted for the other sets in rows without tokens. Copies within a task count once
    while it holds their set (up to ``most`` too), and more often after that, which can
    only let a set through.
    """

    def run(batches):
        seen: set[bytes] = set()
        many = np.empty(0, np.uint64)
        for batch in batches:
            for _, texts in text_slices(batch, "text", chars=8_000_000, rows=4096):
                some, lens, parts = [], [], []
                for x in texts:
                    s = shingle_set(x, words)
                    n = len(s)
                    if n and (own := _set_id(s)) not in seen:
                        seen.add(own)
                        s = s[: n - _least(n, percent) + _extra(n)]
                        some.append(own)
                        lens.append(len(s))
                        parts.append(s)
                if len(seen) > most:
                    seen.clear()
                if not some:
                    continue
                tokens, doc = np.concatenate(parts), np.repeat(np.arange(len(some)), lens)
                known = _among(tokens, many)
                counted, tokens, doc = [doc[known]], tokens[~known], doc[~known]
                order = np.argsort(tokens, kind="stable")
                tokens, doc = tokens[order], doc[order]
                edge = _runs(tokens)
                place = np.arange(len(tokens)) - np.repeat(edge[:-1], np.diff(edge))
                counted.append(doc[place > 1])
                many = np.sort(np.concatenate([many, tokens[place == 1]]))
                if len(many) > most:
                    many = np.empty(0, np.uint64)
                tokens, doc = tokens[place < 2], doc[place < 2]
                low = mixed(tokens, 1)
                bucket = (low >> np.uint64(32)).astype(np.int64) % buckets
                order = np.lexsort((doc, bucket))
                bucket, doc, low = bucket[order], doc[order], low[order].astype(np.uint32)
                ids = np.frombuffer(b"".join(some), _ID)
                rows: list[list] = [[], [], [], []]
                edge = _runs(bucket)
                for a, b in zip(edge[:-1], edge[1:]):
                    cut = _runs(doc[a:b])
                    for c, v in zip(rows, (int(bucket[a]), ids[doc[a:b][cut[:-1]]].tobytes(), np.diff(cut).astype(np.uint32).tobytes(), low[a:b].tobytes())):
                        c.append(v)
                n = np.bincount(np.concatenate(counted), minlength=len(some))
                if n.any():
                    for c, v in zip(rows, (int(ids["a"][0] % np.uint64(buckets)), ids[n > 0].tobytes(), n[n > 0].astype(np.uint32).tobytes(), b"")):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(c, pa.binary()) for c in rows[1:]]], names=["bucket", "ids", "counts", "tokens"])

    return _texts(docs, id_col, text_col).mapInArrow(releasing(run), _PACKED)


def _in_other_sets(rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): how many tokens of each set in the packed rows another set has too.

    A set's tokens count one by one, also where two of them have the same 32 bits; a
    set that comes again, from another task, counts once.
    """
    ids = np.concatenate([np.frombuffer(a, _ID) for a, _, _ in rows])
    counts = np.concatenate([np.frombuffer(b, np.uint32) for _, b, _ in rows]).astype(np.int64)
    tokens = np.concatenate([np.frombuffer(c, np.uint32) for _, _, c in rows])
    ids, one, own = np.unique(ids, return_index=True, return_inverse=True)
    first = np.zeros(len(counts), bool)
    first[one] = True
    held = np.repeat(first, counts)
    own, tokens = np.repeat(own, counts)[held], tokens[held]
    order = np.lexsort((own, tokens))
    t, own = tokens[order], own[order]
    edge = _runs(t)
    shared = own[edge[:-1]] != own[edge[1:] - 1] if len(t) else np.zeros(0, bool)  # owners rise within a run
    n = np.bincount(own[np.repeat(shared, np.diff(edge))], minlength=len(ids))
    return ids[n > 0], n[n > 0]


def _repeated(packed: DataFrame) -> DataFrame:
    """(set_id, repeated): how many of a set's packed tokens another set has too, or more."""

    def out(sums: dict[bytes, int]):
        return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.binary()), pa.array(sums.values(), pa.int64())], names=["set_id", "repeated"])

    def run(batches):
        held, at, sums = [], None, {}

        def add(ids: np.ndarray, n: np.ndarray):
            data = ids.tobytes()
            for k, v in enumerate(n.tolist()):
                own = data[16 * k : 16 * k + 16]
                sums[own] = sums.get(own, 0) + v

        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if b != at and held:
                    add(*_in_other_sets(held))
                    held = []
                if len(sums) > 200_000:
                    yield out(sums)
                    sums.clear()
                at = b
                if row[2]:
                    held.append(tuple(row))
                else:
                    add(np.frombuffer(row[0], _ID), np.frombuffer(row[1], np.uint32))
        if held:
            add(*_in_other_sets(held))
        if sums:
            yield out(sums)

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(releasing(run), "set_id binary, repeated long").groupBy("set_id").agg(F.sum("repeated").alias("repeated"))


def _arrays(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(set_id, tokens, o2, o3) by set: its tokens and its prefixes under the further orders."""

    def run(batches):
        for batch in batches:
            for _, some in text_slices(batch, "text"):
                cols: list[list] = [[], [], [], []]
                for x in some:
                    s = shingle_set(x, words)
                    if not len(s):
                        continue
                    p = len(s) - _least(len(s), percent) + 1
                    cols[0].append(_set_id(s))
                    cols[1].append(s.view(np.int64))
                    for c, seed in zip(cols[2:], ORDERS):
                        c.append((np.sort(mixed(s, seed))[:p] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.list_(pa.int64())), *[pa.array(c, pa.list_(pa.int32())) for c in cols[2:]]], names=["set_id", "tokens", "o2", "o3"])

    return texts.select("text").mapInArrow(releasing(run), "set_id binary, tokens array<long>, o2 array<int>, o3 array<int>")


def linked_components(links: DataFrame, label: str = "components") -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b): the smallest id of its component.

    Large-star and small-star steps in turn: each id's links are moved to the
    smallest id near it until all point at their component's smallest. A step takes
    minima before it shuffles, so an id with very many links meets no one task.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), label)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = written(small.filter("u != v").distinct(), label)
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    comps = edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return comps.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp"))).groupBy("id").agg(F.min("comp").alias("comp"))


def _sets_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``sets`` that a block filter of the pairs' ids can't rule out."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("digest", F.col("id").cast("string"))
    return passing(sets.withColumn("digest", F.col("id").cast("string")), block_filter(ids), True).drop("digest")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that share prefix tokens under each order and are similar.

    The prefixes under the further orders are intersected first; only what is left
    meets its sets' tokens, and tokens of other sets are not sent.
    """
    side = lambda s, *cols: sets.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", *cols)])
    both = lambda rows, *cols: rows.join(side("x", *cols), F.col("a") == F.col("x_id")).join(side("y", *cols), F.col("b") == F.col("y_id"))
    near = written(both(pairs, "o2", "o3").filter(F.arrays_overlap("x_o2", "y_o2") & F.arrays_overlap("x_o3", "y_o3")).select("a", "b"), "near")
    sets = _sets_of(near, sets)
    common = F.size(F.array_intersect("x_tokens", "y_tokens"))
    return both(near, "n", "tokens").withColumn("c", common).filter(100 * F.col("c") >= percent * (F.col("x_n") + F.col("y_n") - F.col("c"))).select("a", "b")


def _unconnected_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of a posting list (token, id, n, pos, comp) in different components.

    Linked sets differ in size by a factor of at most 100 / ``percent``. Lists are cut
    into bands of sizes of that ratio; a set stands in its band and the one above, and a
    pair meets in the higher of its two bands.
    """
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(100 / min(percent, 99) * 1.0001))
    cut = rows.withColumn("own", band(F.col("n"))).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    x = cut.select("token", "band", "id", "n", "pos", "comp", "own")
    y = cut.select("token", "band", F.col("id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("comp").alias("other"), F.col("own").alias("own_b"))
    near = (F.col("comp") < F.col("other")) & (F.greatest("own", "own_b") == F.col("band")) & _may_link(F.col("m"), F.col("q"), F.col("n"), F.col("pos"), percent)
    return x.join(y, ["token", "band"]).filter(near).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))


def _may_link(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m tokens can link if places i and j hold their first common token.

    What stands before it in the order is not shared. A linked pair passes at its
    first common token, so it may fail at all others.
    """
    return (100 + percent) * F.least(n - i, m - j) >= percent * (n + m)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, pivots: int = 3, rounds: int = 3, tokens_per_bucket: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, n_class.

    Sets link when 100 * intersection >= ``percent`` * union; ``component_id`` is
    the smallest id reachable by links. ``n_class`` counts the rows with the very
    same set. Null and empty texts, and texts of white space, have an empty set and
    are linked with nothing; their component is their own id. Rows with a null id
    have a null component, and a text that only they hold links nothing. Repeated
    ids are allowed, with one text or several. An empty table gives an empty result.
    Sets are told apart by 128-bit hashes, tokens by 64-bit hashes. ``id_col`` must be
    of an integral type; at most 16 words make a shingle.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    if not 1 <= words <= 16:
        raise ValueError("words must be 1 to 16")
    integral(docs, id_col)
    owned = written(set_ids(docs, id_col, text_col, words), "set-ids")
    classes = owned.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("n_class"))
    classes = written(classes, "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    labelled = classes.select("set_id", F.col("rep").alias("component_id"), "n_class")
    if total:
        buckets = max(1, math.ceil(total * 0.3 / tokens_per_bucket)) * 8
        with freed_shuffles(docs.sparkSession):
            comps = _set_components(docs, classes, id_col, text_col, words, percent, buckets, pivots, rounds)
        if comps is not None:
            names = comps.join(comps.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("set_id", "component_id")
            labelled = labelled.withColumnRenamed("component_id", "own").join(names, "set_id", "left").select("set_id", F.coalesce("component_id", "own").alias("component_id"), "n_class")
    out = owned.join(labelled, "set_id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), F.coalesce("n_class", F.lit(1).cast("long")).alias("n_class"))


def _set_components(docs, classes, id_col, text_col, words, percent, buckets, pivots, rounds) -> DataFrame | None:
    """(set_id, rep, comp) of the sets that have links; None without links."""
    repeated = _repeated(_packed_tokens(docs, id_col, text_col, words, percent, buckets))
    # a partner has at least ceil(percent n) tokens, and its own share of them
    need = F.floor(F.ceil(F.col("n") * percent / 100) / 10) + 1
    alive = repeated.join(classes.select("set_id", "n", "rep"), "set_id").filter((F.col("repeated") >= need) & F.col("rep").isNotNull())
    # from here on a set goes by a number, fixed by what is written
    alive = written(alive.select("set_id", F.monotonically_increasing_id().alias("id"), "n", "rep", F.col("rep").cast("string").alias("digest")), "alive")
    tagged = _texts(docs, id_col, text_col).withColumn("digest", F.col("id").cast("string"))
    texts = passing(tagged, block_filter(alive), True).join(alive.select(F.col("rep").alias("id")).distinct(), "id")
    # copies go before the join, so that tokens are sent once
    sets = _arrays(texts, words, percent).dropDuplicates(["set_id"]).join(alive.select("set_id", "id", "n"), "set_id").drop("set_id")
    sets = written(sets, "sets")

    tokens = sets.select("id", "n", F.explode("tokens").alias("token"))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = tokens.join(df, "token")
    own = Window.partitionBy("id")
    ranked = shared.withColumn("held", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "token")))
    least = F.ceil(F.col("n") * percent / 100)
    # tokens that no other set has come first in the order and use up the prefix
    prefix = ranked.filter((F.col("held") >= least) & (F.col("rank") <= F.col("held") - least + 1))
    prefix = written(prefix.select("token", "id", "n", (F.col("n") - F.col("held") + F.col("rank") - 1).alias("pos"), ((F.col("n") - F.col("held")) / F.col("n")).alias("alone")), "prefixes")

    links = comps = None
    for step in range(rounds + 1):
        rows = prefix if comps is None else prefix.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        if comps is None:
            rows = rows.withColumn("comp", F.col("id"))
        open_lists = rows.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1").select("token")
        rows = rows.join(open_lists, "token")
        if step < rounds:
            # the set with the smallest share of tokens of its own is near most others; more by hash
            order = [F.struct("alone", F.xxhash64("id", F.lit(step)))] + [F.struct(F.lit(0.0), F.xxhash64("id", F.lit(step * pivots + j))) for j in range(1, pivots)]
            pick = [F.min_by(F.struct("id", "n", "pos", "comp"), o).alias(f"p{j}") for j, o in enumerate(order)]
            chosen = rows.groupBy("token").agg(*pick)
            joined = rows.join(chosen, "token").select("id", "n", "pos", "comp", F.explode(F.array(*[F.col(f"p{j}") for j in range(pivots)])).alias("p"))
            joined = joined.filter((F.col("p.comp") != F.col("comp")) & _may_link(F.col("p.n"), F.col("p.pos"), F.col("n"), F.col("pos"), percent))
            pairs = joined.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
        else:
            pairs = _unconnected_pairs(rows, percent)
        pairs = pairs.distinct()
        if links is not None:
            pairs = pairs.join(links, ["a", "b"], "left_anti")
        found = written(_verified(pairs, sets, percent), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            comps = written(linked_components(links), "comps")
    return None if comps is None else comps.join(alive.select("id", "set_id", "rep"), "id").select("set_id", "rep", "comp")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those of a component's other members.

    The rows with the component's smallest id stay, with all columns, as do rows
    with an empty set or a null id. Most texts are not shuffled: the ids to drop make a
    block filter, and only rows it can't rule out are joined.
    """
    comps = similar_components(docs, id_col, text_col, **options)
    drop = written(comps.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("drop_id")).distinct().withColumn("digest", F.col("drop_id").cast("string")), "drops")
    names = docs.columns
    tagged = docs.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)], F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("digest"))
    filt = block_filter(drop)
    at = f"c_{names.index(id_col)}"
    held = passing(tagged, filt, True)
    kept = held.join(drop.select("drop_id"), held[at] == F.col("drop_id"), "left_anti")
    out = passing(tagged, filt, False).unionByName(kept)
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(names)])
