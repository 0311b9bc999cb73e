"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  An
expectation-maximisation over the counts of vote patterns estimates how often each
labeller votes what on good and on bad documents, and gives every pattern a
posterior.  Posteriors of a bounded sample train a linear scorer over hashed words
and votes, and the scorer judges every document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tally, with_arrow, with_labels
from .hashing import LOWER, PUNCTUATION, U64, Words, mix, per_row, raw_bytes, rolling
from .quality_rules import SLICE, base_counts

LABELLERS = ("symbols", "capitals", "shouting", "tables", "repetition", "variety", "word_length", "flagged_words")
GOOD, BAD, ABSTAIN = 1, -1, 0
WORD_BUCKETS = 1 << 20
FEATURE_BUCKETS = 1 << 18


def banded(value: np.ndarray, good_to: float, bad_from: float, sure: np.ndarray) -> np.ndarray:
    """Good up to one bound, bad from another, no vote between or where not sure."""
    vote = np.where(value <= good_to, GOOD, np.where(value >= bad_from, BAD, ABSTAIN))
    return np.where(sure, vote, ABSTAIN).astype(np.int8)


def word_buckets(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct word (letters and digits, lower case) of each row."""
    lower = LOWER[data]
    words = Words.of(lower, edges, PUNCTUATION)
    joint = np.unique(words.row.astype(np.int64) * WORD_BUCKETS + (words.hashes() % U64(WORD_BUCKETS)).astype(np.int64))
    return joint // WORD_BUCKETS, joint % WORD_BUCKETS


def votes(data: np.ndarray, edges: np.ndarray, flagged: np.ndarray, distinct_words: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """One column per labeller, one row per text; `distinct_words` as word_buckets gives them."""
    prefix = rolling(data)
    words = Words.of(data, edges)
    n_words, word_chars, n_symbols, _, n_repeat = base_counts(data, edges, words, prefix)
    n = np.maximum(1, n_words)
    upper = per_row((data >= 0x41) & (data <= 0x5A), edges)
    letters = np.maximum(1, per_row((data >= 0x41) & (data <= 0x5A) | (data >= 0x61) & (data <= 0x7A), edges))
    last = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    shout = per_row((last == 0x21) & (words.end - words.start > 1) & (data[words.end - 2] == 0x21) if len(last) else last, words.first)
    bars = per_row((last == 0x7C) & (words.end - words.start == 1), words.first)
    row, bucket = distinct_words or word_buckets(data, edges)
    distinct = np.bincount(row, minlength=len(edges) - 1)
    hits = np.bincount(row[flagged[bucket]], minlength=len(edges) - 1)
    some = n_words >= 5
    columns = [
        banded(n_symbols / n, 0.02, 0.2, some),
        banded(upper / letters, 0.1, 0.3, some),
        banded(shout / n, 0.0, 0.1, some),
        banded(bars / n, 0.0, 0.1, some),
        banded(n_repeat / n, 0.2, 0.5, n_words >= 20),
        banded(1 - distinct / n, 0.7, 0.85, n_words >= 20),
        banded(np.abs(word_chars / n - 5.5), 2.0, 4.0, n_words >= 20),
        banded(hits, 0, 1, n_words > 0),
    ]
    return np.stack(columns, axis=1)


def flagged_buckets(docs: DataFrame, labels: DataFrame, least: int = 5, share: float = 0.8) -> np.ndarray:
    """Word buckets that stand in at least `least` documents labelled toxic, which
    are at least `share` of the labelled documents they stand in."""
    toxic = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic_label"))
    marked = with_labels(docs.select("doc_id", "text"), toxic, "doc_id", ["toxic_label"]).filter("toxic_label IS NOT NULL")

    def make():
        def add(text, label):
            row, bucket = word_buckets(*raw_bytes(text))
            on = np.array(label)[row]
            return np.stack([np.bincount(bucket[on], minlength=WORD_BUCKETS), np.bincount(bucket[~on], minlength=WORD_BUCKETS)])

        return add

    bad, fine = tally(marked, ["text", "toxic_label"], WORD_BUCKETS, make)
    return (bad >= least) & (bad >= share * (bad + fine))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, false_alarms: float = 0.002, missed: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "good" for each vote pattern, and the labellers' accuracies:
    [0] how often each says "bad" of a bad document, [1] of a good one, among the
    documents it votes on.  An abstention says nothing.

    Starts from "bad if any labeller says so"; votes are independent given the
    class.  Accuracies are estimated under the constraint that a labeller calls at
    most a share of `false_alarms` of the good documents bad: labellers look for
    different faults, and one that finds its own must not be outvoted by those
    that look for others.  And a share of `missed` of the bad documents that any
    labeller votes on is called bad by none: a class whose members no labeller
    would speak against is no class of bad documents."""
    good = np.where((patterns == BAD).any(axis=1), 0.02, 0.98)
    bad_vote, good_vote = (patterns == BAD).astype(float), (patterns == GOOD).astype(float)
    for _ in range(rounds):
        both = np.stack([1 - good, good]) * counts
        share = (both.sum(axis=1) + 1) / (both.sum() + 2)
        says, denies = both @ bad_vote + 0.5, both @ good_vote + 0.5
        accuracy = says / (says + denies)
        accuracy[1] = np.minimum(accuracy[1], false_alarms)
        log = np.log(share)[:, None] + np.log(accuracy) @ bad_vote.T + np.log(1 - accuracy) @ good_vote.T
        unseen = np.log(1 - accuracy[0]) @ (bad_vote + good_vote).T  # log of the chance that no vote is bad
        if_called = np.log(1 - missed) - np.log(-np.expm1(np.minimum(unseen, -1e-12)))
        log[0] += np.where(bad_vote.any(axis=1), if_called, np.where(good_vote.any(axis=1), np.log(missed) - unseen, 0))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return good, accuracy


def hashed_features(distinct_words: tuple[np.ndarray, np.ndarray], cast: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of each feature: a text's distinct words, scaled to
    unit length together, and each labeller's vote (always the last ones of a row)."""
    row, word = distinct_words
    n, m = cast.shape
    vote = mix((np.arange(m) * 3 + cast + 1).astype(np.int64).view(U64) + U64(1 << 40)) % U64(FEATURE_BUCKETS)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
    return (
        np.concatenate([row, np.repeat(np.arange(n), m)]),
        np.concatenate([word % FEATURE_BUCKETS, vote.ravel().astype(np.int64)]),
        np.concatenate([scale[row], np.ones(n * m)]),
    )


def train_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 10, rate: float = 0.3) -> np.ndarray:
    """Logistic regression over hashed features (buckets and values of each row) on
    soft labels, by AdaGrad over batches in a fixed order."""
    weights, squares = np.zeros(FEATURE_BUCKETS + 1), np.full(FEATURE_BUCKETS + 1, 1e-6)
    for _ in range(epochs):
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64]
            flat, value = (np.concatenate(x) for x in zip(*part))
            owner = np.repeat(np.arange(len(part)), [len(b) for b, _ in part])
            z = np.bincount(owner, weights=weights[flat] * value, minlength=len(part)) + weights[-1]
            error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target[at : at + 64]
            slope = np.bincount(flat, weights=error[owner] * value, minlength=len(weights)) / len(part)
            slope[-1] = error.mean()
            slope += 1e-6 * weights
            squares += slope * slope
            weights -= rate * slope / np.sqrt(squares)
    return weights


@dataclass(frozen=True)
class QualityModel:
    flagged: np.ndarray
    posteriors: dict[bytes, float]
    accuracies: np.ndarray
    weights: np.ndarray


def cast_votes(docs: DataFrame, flagged: np.ndarray) -> DataFrame:
    """`docs` plus `votes`, one byte (vote + 1) per labeller."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(flagged))

    def make():
        bits = np.unpackbits(shared.value).astype(bool)

        def fn(column):
            cast = votes(*raw_bytes(column), bits) + 1
            return [pa.array([r.tobytes() for r in cast.astype(np.uint8)], pa.binary())]

        return fn

    return with_arrow(docs, ["text"], {"votes": "binary"}, make, slice_bytes=SLICE)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 6000) -> QualityModel:
    """Learn from all documents' votes; labelled rows only give the flagged words.

    `train_rows` bounds the sample (by a hash of the id, about that many rows) that
    trains the linear scorer.  The driver gets at most 3**8 vote patterns and that sample."""
    flagged = flagged_buckets(docs, labels)
    voted = cast_votes(docs.select("doc_id", "text"), flagged)
    found = voted.groupBy("votes").count().collect()
    if not found:
        return QualityModel(flagged, {}, np.zeros((2, len(LABELLERS))), np.zeros(FEATURE_BUCKETS + 1))
    patterns = np.array([np.frombuffer(bytes(r["votes"]), np.uint8) for r in found]).astype(int) - 1
    counts = np.array([r["count"] for r in found])
    good, accuracies = estimate(patterns, counts)
    posteriors = {bytes(r["votes"]): float(g) for r, g in zip(found, good)}
    part = max(1, -(-int(counts.sum()) // train_rows))
    sample = cast_votes(docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0), flagged)

    def make():
        def fn(column, cast):
            votes_ = np.array([np.frombuffer(v, np.uint8) for v in cast.to_pylist()]).astype(int) - 1
            row, bucket, value = hashed_features(word_buckets(*raw_bytes(column)), votes_)
            order = np.argsort(row, kind="stable")
            ends = pa.array(np.searchsorted(row[order], np.arange(len(column) + 1)).astype(np.int32))
            return [pa.ListArray.from_arrays(ends, pa.array(bucket[order].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(value[order].astype(np.float32)))]

        return fn

    features = with_arrow(sample, ["text", "votes"], {"buckets": "array<int>", "weights": "array<float>"}, make, drop=("text",), slice_bytes=SLICE)
    rows = sorted(features.select("doc_id", "votes", "buckets", "weights").toArrow().to_pylist(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["buckets"]))
    weights = train_linear([(np.array(r["buckets"], np.int64), np.array(r["weights"])) for r in rows], np.array([posteriors[r["votes"]] for r in rows])) if rows else np.zeros(FEATURE_BUCKETS + 1)
    return QualityModel(flagged, posteriors, accuracies, weights)


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """`docs` plus `score` (the scorer's probability of "good") and `kept` (0.5 or more).

    A null or empty text has abstaining votes only and is judged by the scorer
    like any other; repeated rows alike; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((np.packbits(model.flagged), model.weights.astype(np.float32)))

    def make():
        bits, weights = np.unpackbits(shared.value[0]).astype(bool), shared.value[1]

        def fn(column):
            data, edges = raw_bytes(column)
            words = word_buckets(data, edges)
            row, bucket, value = hashed_features(words, votes(data, edges, bits, words).astype(int))
            z = np.bincount(row, weights=weights[bucket] * value, minlength=len(edges) - 1) + weights[-1]
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))]

        return fn

    return with_arrow(docs, ["text"], {"score": "double"}, make, slice_bytes=SLICE).withColumn("kept", F.col("score") >= 0.5)
