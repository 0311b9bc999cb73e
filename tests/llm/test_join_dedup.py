"""Near copies, repeated strings and benchmark phrases against brute force."""

import collections
import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notewarden.llm import decontaminate, hashing, induced_sort, ngram_join, suffix_dedup
from notewarden.llm.common import give_back, slices
from notewarden.llm.hashing import raw_bytes

from .helpers import ALNUM, corpus, hit_words, low, prose, similar_components, without_repeats


@pytest.mark.parametrize("seed", [5, 6])
def test_join(docs_of, seed):
    rows = corpus(seed)
    got = ngram_join.join(docs_of(rows))[0].collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(similar_components(rows), key=repr)


def test_keep_one(spark, docs_of):
    rows = corpus()
    kept = ngram_join.keep_one(docs_of(rows).withColumn("uid", F.lit("mine")).withColumn("label", F.lit(None).cast("int")))
    assert kept.columns == ["doc_id", "text", "uid", "label"]
    want = {c for (_, n, c) in similar_components(rows) if n} | {d for d, n, _ in similar_components(rows) if not n}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert ngram_join.keep_one(docs_of([])).collect() == []


def test_similar_filters():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64)
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 60, 2).astype(np.uint64)]))
        shared, both = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert ngram_join.similar(x, y, 80) == (100 * shared >= 80 * both)
        assert ngram_join.apart(x, y, 10**9) <= both - shared


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    got = {r.set_id: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda a: a if parent.setdefault(a, a) == a else find(parent[a])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {a: find(a) for a in parent}


def test_joined_labels(spark):
    rng = np.random.default_rng(3)
    labelled = lambda df: {r.set_id: r.label for r in df.collect()}
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    first = [tuple(map(int, rng.integers(0, 80, 2))) for _ in range(40)]
    more = [tuple(map(int, rng.integers(0, 100, 2))) for _ in range(15)]
    assert labelled(ngram_join.joined_labels(ngram_join.components(frame(first)), frame(more))) == labelled(ngram_join.components(frame(first + more)))


def test_sketches():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 400))).astype(np.uint64)
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.choice([0, 0.5, 0.9])], rng.integers(0, 1 << 60, rng.integers(1, 40)).astype(np.uint64)]))
        one, two = ngram_join.sketches(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])).to_pylist()
        may = ngram_join.may_be_similar(one, two, len(x), len(y), 80)
        assert may or not ngram_join.similar(x, y, 80)
    apart = rng.integers(0, 1 << 60, 600).astype(np.uint64)
    one, two, none = ngram_join.sketches(apart, np.array([0, 300, 600, 600])).to_pylist()
    assert not ngram_join.may_be_similar(one, two, 300, 300, 80) and ngram_join.may_be_similar(one, one, 300, 300, 80) and not any(none)


@pytest.mark.parametrize("seed", [5, 6])
def test_join_of_large_groups(docs_of, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 2)
    rows = corpus(seed)
    got = ngram_join.join(docs_of(rows))[0].collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(similar_components(rows), key=repr)


def test_chance_meetings_move_no_text(docs_of, monkeypatch):
    """Texts that share some rare shingles only are told apart by their sketches."""
    rng = np.random.default_rng(7)
    passages = [prose(rng, 12, 4000) for _ in range(6)]
    rows = [(i, prose(rng, 60, 4000) + " " + passages[i % 6] + " " + prose(rng, 60, 4000)) for i in range(60)]
    counts, stored = {}, ngram_join.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    got = ngram_join.join(docs_of(rows))[0].collect()
    assert sorted(r.component_id for r in got) == list(range(60))
    assert counts["sides"] > 0 and counts["pairs"] <= 3 and counts["open-pairs"] <= 3 and "added" not in counts


@pytest.mark.parametrize("entries", [1, 4_000_000])
def test_suffix_order(monkeypatch, entries):
    monkeypatch.setattr(induced_sort, "QUEUE_ENTRIES", entries)
    rng = np.random.default_rng(1)
    for trial in range(60):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 200))
        t = np.tile(t[: max(1, len(t) // 7)], 8) if trial % 3 == 0 else t
        t = np.append(t, 0).astype(np.uint16)
        depth = int(rng.integers(2, 40))
        order, shared = induced_sort.suffix_order(t, depth)
        cut = [tuple(t[i : i + depth].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(len(t))) and cut == sorted(cut)
        for k in range(1, len(cut)):
            same = [a == b for a, b in zip(cut[k - 1], cut[k])]
            assert shared[k] == (same.index(False) if False in same else len(same))


def test_large_alphabet_recursion():
    rng = np.random.default_rng(4)
    t = np.append(np.tile(rng.integers(1, 8, 3000), 3), 0).astype(np.uint16)
    order, _ = induced_sort.suffix_order(t, 50)
    cut = [tuple(t[i : i + 50].tolist()) for i in order]
    assert cut == sorted(cut)


@pytest.mark.parametrize("length", [200, 90])
def test_remove_repeats(docs_of, length):
    rows = corpus()
    df = docs_of(rows).withColumn("KEPT", F.lit(1)).withColumn("lo", F.lit("x"))
    got = suffix_dedup.remove_repeats(df, length).collect()
    want = [(d, *w) for (d, _), w in zip(rows, without_repeats([t for _, t in rows], length))]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("largest", [0, 600])
def test_large_keys_meet_by_windows(docs_of, monkeypatch, largest):
    rng = np.random.default_rng(8)
    line = prose(rng, 40, 4000)[:150]
    around = [prose(rng, 30, 4000)[:120] for _ in range(12)]
    texts_ = [around[i % 12] + line + around[i * 5 % 12] for i in range(30)] + [t for _, t in corpus()]
    docs = docs_of(list(enumerate(texts_))).selectExpr("doc_id AS uid", "coalesce(text, '') AS text")
    sizes, whole = [], suffix_dedup.hashed_ranges
    monkeypatch.setattr(suffix_dedup, "hashed_ranges", lambda contexts, length: sizes.append(contexts.count()) or whole(contexts, length))
    covered = {}
    for r in suffix_dedup.repeated_ranges(docs, 200, largest).collect():
        covered.setdefault(r.uid, set()).update(range(r.lo, r.hi))
    want = [w[1] for w in without_repeats(texts_, 200)]
    assert [len(covered.get(i, ())) for i in range(len(texts_))] == want and sizes and sizes[0] > 2


def test_remove_repeats_as_text(docs_of):
    df = docs_of(corpus())
    want = suffix_dedup.decoded(suffix_dedup.remove_repeats(df))
    got = suffix_dedup.remove_repeats(df, as_text="text")
    last = lambda d: d._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert last(got) == last(want) - 1
    columns = ["doc_id", "text", "n_bytes", "n_removed", "n_spans"]
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.select(columns).collect())) and sorted(got.columns) == sorted(columns)


def test_tasks_keep_no_powers():
    hashing.powers(100_000)
    give_back()
    assert len(hashing._POWERS["up"]) == len(hashing._POWERS["down"]) == 1
    assert hashing.powers(3)[0].tolist() == [1, hashing._BASE, hashing._BASE**2 % 2**64]


def test_remove_repeats_small(docs_of):
    assert suffix_dedup.remove_repeats(docs_of([])).collect() == []
    got = suffix_dedup.remove_repeats(docs_of([(1, "a" * 199), (2, "a" * 199), (3, None)])).collect()
    assert all(r.n_removed == 0 for r in got)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions tonight"), (2, "Two words"), (3, None), (4, "..."), (5, "rare"), (2, "Two words"), (11, "a b a b a b a b a b a b a b a b"), (None, "lone phrase")]


def texts():
    long = ITEMS[0][1]
    return [
        (1, long), (2, "x " * 500 + low(long) + " y" * 10), (3, "x " + " ".join(long.split()[1:14]) + " z"), (4, " ".join(long.split()[:12])), (5, "TWO, words! two words"), (6, "two other words"),
        (7, None), (8, ""), (9, "a b " * 40), (10, "RARE-thing rare"), (11, "quick fox"), (12, "w " * 200 + "rare"), (1, long), (13, "lone\x00phrase é"), (14, "words two wizards quietly brown quick mix"),
    ]


def test_marks(spark, docs_of):
    rows = texts()
    df = docs_of(rows).withColumn("pos", F.lit(1)).withColumn("word", F.lit("q")).withColumn("n_hit", F.lit("old"))
    got = decontaminate.mark(df, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    want = [(d, n, h, ids, h > 0 and 20 * h >= n) for (d, _), (n, h, ids) in zip(rows, hit_words([t for _, t in rows], ITEMS))]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got), key=repr) == sorted(want, key=repr)


def test_marks_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.mark(docs_of([(1, "a")]), none).collect()] == [False]
    assert decontaminate.mark(docs_of([]), none).collect() == []


def test_proximity(spark, docs_of):
    rows = [(d, t) for d, t in texts() if t]
    docs = docs_of(rows).withColumn("uid", F.col("doc_id"))
    terms = decontaminate.item_terms(spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    index = decontaminate.build_index(docs, terms)
    got = {(r.uid, r.lo, r.hi) for r in decontaminate.proximity_matches(index, terms, rarest=2, slop=8).collect()}
    freq = {}
    words = {d: ALNUM.findall(low(t)) for d, t in rows}
    vocabulary = set(ALNUM.findall(low(ITEMS[0][1])))
    for d, t in rows:
        for w in ALNUM.findall(low(t)):
            freq[w] = freq.get(w, 0) + (w in vocabulary)
    first, second = sorted(vocabulary, key=lambda w: (freq.get(w, 0), w))[:2]
    want = set()
    for d, ws in words.items():
        for i, w in enumerate(ws):
            near = [j for j, x in enumerate(ws) if x == second and abs(i - j) < 8]
            if w == first and near:
                j = min(near, key=lambda j: (abs(i - j), j))
                want.add((d, min(i, j), max(i, j)))
    assert got == want and got


@pytest.mark.parametrize("rarest", [1, 2, 3, 4])
def test_proximity_by_brute_force(spark, docs_of, rarest):
    rng, slop = np.random.default_rng(6), 20
    told = {50: "aa", 40: "bb", 61: "bb", 62: "cc"}  # the nearest of each term are too far apart, 50, 61 and 62 are not
    rows = [(1, " ".join(told.get(i, "x") for i in range(90)))]
    rows += [(d, " ".join(rng.choice(["aa", "bb", "cc", "dd", "x"], 400, p=[0.02, 0.03, 0.04, 0.05, 0.86]))) for d in range(2, 8)]
    terms = decontaminate.item_terms(spark.createDataFrame([(1, "aa bb cc dd"), (2, "bb aa cc"), (3, "aa")], "item_id long, text string"))
    index = decontaminate.build_index(docs_of(rows).withColumn("uid", F.col("doc_id")), terms)
    found = decontaminate.proximity_matches(index, terms, rarest=rarest, slop=slop).collect()
    freq = collections.Counter(w for _, t in rows for w in t.split())
    want = set()
    for item, text in ((1, "aa bb cc dd"), (2, "bb aa cc"), (3, "aa")):
        head, *others = sorted(text.split(), key=lambda w: (freq[w], w))[:rarest]
        for d, t in rows:
            places = {w: [i for i, x in enumerate(t.split()) if x == w] for w in (head, *others)}
            for at in places[head]:
                near = [[p for p in places[w] if abs(p - at) < slop] for w in others]
                spans = [(max(at, *c, at) - min(at, *c, at), min(at, *c, at)) for c in itertools.product(*near)]
                spans = [s for s in spans if s[0] < slop]
                if spans:
                    width, lo = min(spans)
                    want.add((d, item, lo, lo + width))
    assert {(r.uid, r.item_id, r.lo, r.hi) for r in found} == want
    assert rarest != 3 or (1, 2, 50, 62) in want


def test_anchors_of_a_batch_take_little_memory():
    batch = pa.RecordBatch.from_arrays([pa.array([prose(np.random.default_rng(i), 800, 4000) for i in range(700)])], names=["text"])
    tracemalloc.start()
    for part in slices(batch, suffix_dedup.SLICE):
        suffix_dedup.anchors(*raw_bytes(part.column(0)), 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
