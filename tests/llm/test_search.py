"""Ranked search against whole-number arithmetic in Python."""

import collections
import math

import numpy as np
from .helpers import ALNUM, corpus, low
from pyspark.sql import functions as F

from notewarden.llm import ranked_search


def plain(docs, items, k):
    bags = [(d, collections.Counter(ALNUM.findall(low(t)))) for d, t in docs]
    n_all, l_all = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            score = 0
            for term in set(ALNUM.findall(low(text))):
                if term in bag:
                    w = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[term] + 1)))
                    m = 100 - 50 + 50 * sum(bag.values()) * n_all // l_all
                    score += w * (10**9 * bag[term] // (1000 * bag[term] + 20 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, n, x[3], -x[0]) for n, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, k=50):
    found = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k)
    assert dict(found.dtypes)["rank"] == "int"
    return sorted((tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_of(docs, seed=2):
    rng = np.random.default_rng(seed)
    out = [(i, " ".join(rng.permutation((docs[i % 8][1] or "x").split())[:20])) for i in range(70)]
    return out + [(100, None), (101, ""), (102, " .,;"), (103, "W1 w1 w2"), (104, "none of these"), (None, "w3 w4"), (7, "w5"), (7, "w5"), (105, "é🙂ß漢字"), (106, "one two")]


def test_against_plain(spark):
    docs = corpus()
    items = items_of(docs)
    assert run(spark, docs, items, 5) == plain(docs, items, 5)
    assert run(spark, docs, items, 50) == plain(docs, items, 50)


def test_ties_go_by_id_across_partitions_and_slices(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "TILE_DOCS", 3)
    docs = [(i, "alpha beta") for i in range(300, 0, -1)] + [(None, "alpha beta"), (400, "gamma"), (401, "")]
    items = [(1, "alpha"), (2, "beta gamma"), (3, "delta")]
    assert run(spark, docs, items, 10) == plain(docs, items, 10)


def test_cuts_stay_exact(spark, monkeypatch):
    """Small limits make many cuts of a vocabulary; the sums do not change."""
    rng = np.random.default_rng(6)
    terms = [np.unique(rng.integers(0, 500, 60)) for _ in range(10)]
    weight = rng.integers(0, 9000, 500)
    parts = ranked_search.tiles(terms, weight, 4, 50, 9000 * ranked_search.MAX_IMPACT * 20)
    assert len(parts) > 6 and max(len(p.terms) for p in parts) <= 20
    for p in parts:
        assert (p.weights(weight).sum(axis=0) * ranked_search.MAX_IMPACT).max() < 9000 * ranked_search.MAX_IMPACT * 20
    whole = np.zeros((10, 500), np.int64)
    for p in parts:
        whole[np.ix_(p.items, p.terms)] += p.weights(weight).astype(np.int64).T
    assert (whole == np.array([[weight[t] if t in set(x) else 0 for t in range(500)] for x in terms])).all()
    monkeypatch.setattr(ranked_search, "TILE_TERMS", 7)
    docs = corpus()
    assert run(spark, docs, items_of(docs), 9) == plain(docs, items_of(docs), 9)


def test_several_passes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "PASS_BYTES", 3000)
    docs = corpus()
    assert run(spark, docs, items_of(docs), 7) == plain(docs, items_of(docs), 7)


def test_large_counts_do_not_overflow():
    n, tf = np.array([10**7]), np.array([10**6])
    assert ranked_search.impacts(n, np.array([0]), tf, 10**12, 10**15)[0] == 10**9 * 10**6 // (1000 * 10**6 + 20 * (50 + 50 * 10**7 * 10**12 // 10**15))


def test_empty_tables_extra_columns_and_very_long_text(spark):
    docs = [(1, "alpha " * 300_000 + "beta"), (2, "alpha beta")]
    assert run(spark, [], [(1, "alpha")]) == []
    assert run(spark, docs, []) == []
    assert run(spark, docs, [(1, "alpha beta")]) == plain(docs, [(1, "alpha beta")], 50)
    left = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"q": F.lit(1), "rank": F.lit("r"), "score": F.lit(0)})
    right = spark.createDataFrame([(1, "beta")], "item_id long, text string").withColumns({"doc_id": F.lit(5), "digest": F.lit("d")})
    assert sorted(tuple(r)[:3] for r in ranked_search.search(left, right).collect()) == sorted(x[:3] for x in plain(docs, [(1, "beta")], 50))


