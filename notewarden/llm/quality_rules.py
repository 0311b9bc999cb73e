"""Quality rules with a hashed n-gram log-likelihood ratio.

The base rules are counts of each text.  The verdict compares two multinomials
over hashed word n-grams: the trusted documents' and the whole corpus's.  Each
bucket's ratio is taken against its expected count, so that buckets with little
evidence weigh nothing; a document's score is the mean ratio of its n-grams, and
every document is held against one threshold."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tally, with_arrow, with_labels
from .hashing import SPACE, U64, Words, mix, ngrams, per_row, raw_bytes, rolling, span_hash

SLICE = 2_000_000
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def repeated(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur again in its row, and is it there for the second time or later."""
    joint = mix(keys ^ mix(row.astype(U64) + U64(1)))
    _, first, inverse, counts = np.unique(joint, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return counts[inverse] > 1, later


def base_counts(data: np.ndarray, edges: np.ndarray, words: Words, prefix: np.ndarray) -> list[np.ndarray]:
    """The columns of BASE for each row."""
    lead = (data & 0xC0) != 0x80
    hashes = words.hashes(prefix)
    tri, at = ngrams(hashes, words.row, 3)
    again = repeated(tri, words.row[at])[0] if len(tri) else np.zeros(0, bool)
    marked = np.zeros(len(words.start) + 2, bool)
    for k in range(3):
        marked[at[again] + k] = True
    breaks, rows = np.flatnonzero(data == 0x0A), np.arange(len(edges) - 1)
    at = np.searchsorted(edges, breaks, side="right") - 1  # the row of each line end
    # lines start with their row and after each line end, and end before a line end and with their row
    row = np.sort(np.concatenate([rows, at]))
    starts = np.concatenate([edges[:-1], breaks + 1])[np.argsort(np.concatenate([rows, at]), kind="stable")]
    ends = np.concatenate([breaks, edges[1:]])[np.argsort(np.concatenate([at, rows]), kind="stable")]
    has_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    lines = np.flatnonzero(has_word)
    later = repeated(span_hash(prefix, starts[lines], ends[lines]), row[lines])[1] if len(lines) else np.zeros(0, bool)
    dup = np.bincount(row[lines][later], minlength=len(edges) - 1) if len(lines) else np.zeros(len(edges) - 1)
    return [words.counts(), per_row(lead & ~SPACE[data], edges), per_row(SYMBOL[data], edges), dup, per_row(marked[: len(words.start)], words.first)]


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus the columns of BASE and `base_failed`.  Null and empty texts
    have no words and fail.  Row-local."""

    def make():
        def fn(column):
            data, edges = raw_bytes(column)
            return [pa.array(c, pa.int64()) for c in base_counts(data, edges, Words.of(data, edges), rolling(data))]

        return fn

    out = with_arrow(docs, [text], BASE, make, slice_bytes=SLICE)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


@dataclass(frozen=True)
class RatioModel:
    """Weights of the hashed n-grams, and the least score of a kept document."""

    weights: np.ndarray
    orders: tuple[int, ...]
    threshold: float


def features(data: np.ndarray, edges: np.ndarray, orders: tuple[int, ...], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram."""
    words = Words.of(data, edges)
    hashes, buckets, rows = words.hashes(), [], []
    for n in orders:
        grams, at = ngrams(hashes, words.row, n)
        buckets.append((grams % U64(size)).astype(np.int64))
        rows.append(words.row[at])
    return np.concatenate(buckets), np.concatenate(rows)


def ratio_weights(raw: np.ndarray, target: np.ndarray, sigmas: float, ceiling: float) -> np.ndarray:
    """log of (target + 1) / (expected + 1) for each bucket, where expected is the
    target's total spread like the corpus; 0 where the difference is within
    `sigmas` of chance.  Evidence for a document is held to `ceiling`, so that
    common words do not outweigh what speaks against it."""
    expected = raw * (target.sum() / max(raw.sum(), 1))
    llr = np.log((target + 1) / (expected + 1))
    llr[np.abs(target - expected) <= sigmas * np.sqrt(expected + 1)] = 0
    return np.minimum(llr, ceiling).astype(np.float32)


def one_label(labels: DataFrame) -> DataFrame:
    """One row per document: trusted if all its labels say good and none toxic;
    rows with a null document or without any label are left out."""
    good = (F.coalesce(F.min("quality"), F.lit(1)) == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)
    known = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    return known.groupBy("doc_id").agg(good.alias("trusted"))


def fit_ratio(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 20, orders: tuple[int, ...] = (1,), sigmas: float = 1.5, ceiling: float = 0.02) -> RatioModel:
    """Count n-grams of all documents and of the trusted ones, then choose the
    threshold below zero that parts the labelled documents best (the mean of the
    shares of trusted documents kept and of others rejected; ties: the lowest).

    Without labels every weight is 0 and every document is kept."""
    marked = with_labels(docs.select("doc_id", "text"), one_label(labels), "doc_id", ["trusted"])

    def make():
        def add(text, trusted):
            data, edges = raw_bytes(text)
            found, row = features(data, edges, orders, buckets)
            chosen = np.array(trusted.fill_null(False))[row]
            return np.stack([np.bincount(found, minlength=buckets), np.bincount(found[chosen], minlength=buckets)])

        return add

    raw, target = tally(marked, ["text", "trusted"], buckets, make)
    weights = ratio_weights(raw, target, sigmas, ceiling)
    model = RatioModel(weights, orders, float("-inf"))
    binned = score(marked.filter("trusted IS NOT NULL"), model).groupBy(F.round("score", 4).alias("s")).agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad")).filter("s < 0").collect()
    n_good, n_bad = (marked.filter("trusted IS NOT NULL").agg(F.count_if("trusted"), F.count_if(~F.col("trusted"))).first())
    best, threshold, good, bad = 1.0, float("-inf"), 0, 0
    for r in sorted(binned, key=lambda r: r["s"]):  # all up to this score are rejected
        good, bad = good + r["good"], bad + r["bad"]
        value = (n_good - good) / max(n_good, 1) + bad / max(n_bad, 1)
        if value > best:
            best, threshold = value, r["s"] + 0.00005
    return RatioModel(weights, orders, threshold)


def score(docs: DataFrame, model: RatioModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` plus the mean weight of each text's n-grams (0 without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)
    orders, size = model.orders, len(model.weights)

    def make():
        def fn(column):
            data, edges = raw_bytes(column)
            found, row = features(data, edges, orders, size)
            n = len(edges) - 1
            total = np.bincount(row, weights=shared.value[found], minlength=n)
            return [pa.array(total / np.maximum(1, np.bincount(row, minlength=n)))]

        return fn

    return with_arrow(docs, [text], {out: "double"}, make, slice_bytes=SLICE)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` plus the base columns, `score` and `kept`.

    Every row is judged by its own text; repeated rows alike; columns of the same
    names are replaced; an empty table gives an empty table."""
    model = fit_ratio(docs, labels)
    judged = score(base_rules(docs), model)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= model.threshold))
