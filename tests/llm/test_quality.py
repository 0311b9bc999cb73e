"""Base rules against brute force, verdicts against held-out labels."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewarden.llm import quality_rules, weak_quality

from .helpers import SPACED, corpus

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    w = SPACED.findall(text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    marked = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


EXTRA = [(100, "a\na\n\na \na"), (101, "\n\n"), (102, "x y z x y z\nx y z"), (103, "a a a a"), (104, "é\r\né\r\né"), (105, "a\n" * 3 + "a"), (106, "#|<>** \x0b b\x85c")]


def test_base_rules(docs_of):
    rows = corpus() + EXTRA
    got = quality_rules.base_rules(docs_of(rows)).collect()
    assert [tuple(r[c] for c in quality_rules.BASE) for r in got] == [brute(t) for _, t in rows]
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)


def test_lines_do_not_depend_on_the_rows_before(spark):
    texts = ["x", "\nab\nab", "", "\n\nab\n\nab\n", "ab\n", "\nab", None, "\n", "ab\nab\nab"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = quality_rules.base_rules(docs).orderBy("doc_id").collect()
    assert [r.n_dup_lines for r in got] == [brute(t)[3] for t in texts] == [0, 1, 0, 1, 0, 0, 0, 0, 2]


def test_without_labels_or_rows(spark, docs_of):
    rows = corpus()
    none = spark.createDataFrame([], LABELS)
    got = quality_rules.judge(docs_of(rows), none).collect()
    assert len(got) == len(rows) and all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.judge(docs_of([]), none).collect() == []
    model = weak_quality.fit(docs_of(rows), none)
    assert weak_quality.judge(docs_of(rows), model).count() == len(rows)
    assert weak_quality.judge(docs_of([]), weak_quality.fit(docs_of([]), none)).collect() == []


def test_ratio_by_hand():
    raw, target = np.array([100, 900, 0]), np.array([0, 500, 0])
    weights = quality_rules.ratio_weights(raw, target, 1.5, 0.02)
    assert np.isclose(weights[0], np.log(1 / 51)) and weights[1] == np.float32(0.02) and weights[2] == 0


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(3)
    n, m = 20000, 5
    bad = rng.random(n) < 0.2
    kind = rng.integers(0, m, n)
    votes = np.where(rng.random((n, m)) < 0.0005, -1, 1)
    votes[bad, kind[bad]] = -1
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good, accuracy = weak_quality.estimate(patterns, counts)
    assert ((good[where.ravel()] < 0.5) == bad).mean() > 0.98
    assert (accuracy[0] > 0.1).all() and (accuracy[1] <= 0.002).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out(spark):
    """Labels of odd documents are held out."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    for judged in (weak_quality.judge(docs, weak_quality.fit(docs, seen)), quality_rules.judge(docs, seen).filter("NOT base_failed")):
        rows = judged.select("doc_id", "kept").join(held, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
        kept = {(r.quality, r.toxic): r.kept for r in rows}
        assert kept[(1, 0)] > 0.93
        assert kept[(1, 1)] < 0.15 and kept[(0, 0)] < 0.15
