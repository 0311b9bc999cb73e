"""Ranked lexical search: item tiles times document tiles in float64.

Items are queries against all documents.  A tile of items has a compact vocabulary of
its own terms; a tile of documents becomes a dense matrix of their impacts on that
vocabulary, and one matrix product gives all scores of the two tiles.  Vocabularies are
cut so that every sum stays below 2**53, where float64 counts whole numbers exactly;
the sums of the cuts are added as integers.  Each task keeps the best documents of each
item, with ties by the smaller doc_id, and Spark merges them."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import importable, slices, small_batches, tally
from .hashing import LOWER, PUNCTUATION, Words, raw_bytes

#: Items and columns of a tile, and documents of a tile.
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 64, 4096, 512
#: Bytes of query texts of one pass over the documents; more queries take more passes.
PASS_BYTES = 16_000_000
EXACT = 1 << 53
#: No term's impact reaches this.
MAX_IMPACT = 1_000_000
SLICE_BYTES = 1_000_000
#: Groups of partitions whose best documents are merged before all are.
MERGES = 256


def words_of(column: pa.Array) -> Words:
    data, edges = raw_bytes(column)
    return Words.of(LOWER[data], edges, PUNCTUATION)


@dataclass(frozen=True)
class Tile:
    """Items `items` and the terms of one cut of their vocabulary: `terms` (places in
    the whole vocabulary), and for each (term, item) its place in the tile."""

    items: np.ndarray
    terms: np.ndarray
    term_at: np.ndarray
    item_at: np.ndarray

    def weights(self, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.terms), len(self.items)))
        out[self.term_at, self.item_at] = weight[self.terms[self.term_at]]
        return out


def query_terms(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The vocabulary of the texts (sorted hashes) and each text's places in it."""
    w = words_of(pa.array(texts, pa.large_string()))
    vocabulary, at = np.unique(w.hashes(), return_inverse=True)
    return vocabulary, [np.unique(at[w.first[i] : w.first[i + 1]]) for i in range(len(texts))]


def tiles(terms_of: list[np.ndarray], weight: np.ndarray, n_items: int = TILE_ITEMS, n_terms: int = TILE_TERMS, exact: int = EXACT) -> list[Tile]:
    """Items in tiles, each tile's vocabulary in cuts of at most `n_terms` whose sums stay below `exact`."""
    out = []
    for at in range(0, len(terms_of), n_items):
        part = terms_of[at : at + n_items]
        term, item = np.concatenate([*part, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(part)), [len(t) for t in part])
        heaviest = int(weight[term].max(initial=1)) or 1
        width = max(1, min(n_terms, (exact - 1) // (heaviest * MAX_IMPACT)))
        vocabulary = np.unique(term)
        for cut in range(0, len(vocabulary), width):
            columns = vocabulary[cut : cut + width]
            inside = np.flatnonzero((term >= columns[0]) & (term <= columns[-1]))
            out.append(Tile(np.arange(at, at + len(part)), columns, np.searchsorted(columns, term[inside]), item[inside]))
    return out


def term_counts(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each row, and the row, vocabulary place and count of each query term in it."""
    w = words_of(column)
    hashes = w.hashes()
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    hit = np.flatnonzero(vocabulary[at] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
    pair, tf = np.unique(w.row[hit] * max(len(vocabulary), 1) + at[hit], return_counts=True)
    return w.counts(), pair // max(len(vocabulary), 1), pair % max(len(vocabulary), 1), tf


def impacts(n_terms: np.ndarray, row: np.ndarray, tf: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 20 * m), m = 50 + (50 * n * N) div L, in whole numbers."""
    if len(n_terms) and 50 * int(n_terms.max()) * n_docs >= 1 << 63:
        m = np.array([50 + 50 * int(n) * n_docs // n_words for n in n_terms], np.int64)
    else:
        m = 50 + 50 * n_terms.astype(np.int64) * n_docs // max(n_words, 1)
    return 10**9 * tf // (1000 * tf + 20 * m[row])


class Best:
    """The `k` best documents of each item so far: highest score first, ties by the
    smaller id, null ids first."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.item = self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if not len(item):
            return
        item, score, ids, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, ~null, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        place = np.arange(len(item)) - first
        order, item, place = order[place < self.k], item[place < self.k], place[place < self.k]
        self.item, self.score, self.id, self.null = item, score[order], ids[order], null[order]
        full = place == self.k - 1
        self.floor[item[full]] = self.score[full]

    def consider(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """`scores`: documents by items.  What is below an item's last place goes at
        once; what equals it is kept, since its id may be smaller."""
        doc, at = np.nonzero(scores >= self.floor[items][None, :])
        self.add(items[at], scores[doc, at], ids[doc], null[doc])


def score_slice(best: Best, ids: pa.Array, texts: pa.Array, vocabulary: np.ndarray, weight: np.ndarray, parts: list[Tile], n_docs: int, n_words: int) -> None:
    n_terms, row, term, tf = term_counts(texts, vocabulary)
    impact = impacts(n_terms, row, tf, n_docs, n_words)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.full(len(vocabulary), -1, np.int64)
    for at in range(0, len(numbers), TILE_DOCS):
        upto = min(at + TILE_DOCS, len(numbers))
        lo, hi = np.searchsorted(row, (at, upto))
        total = None
        for n, tile in enumerate(parts):
            place[tile.terms] = np.arange(len(tile.terms))
            inside = lo + np.flatnonzero(place[term[lo:hi]] >= 0)
            dense = np.zeros((upto - at, len(tile.terms)))
            dense[row[inside] - at, place[term[inside]]] = impact[inside]
            place[tile.terms] = -1
            scores = (dense @ tile.weights(weight)).astype(np.int64)
            total = scores if total is None else total + scores
            if n + 1 == len(parts) or parts[n + 1].items[0] != tile.items[0]:
                best.consider(tile.items, total, numbers[at:upto], null[at:upto])
                total = None


def _pass(docs: DataFrame, key: str, text: str, texts: list[str], k: int) -> DataFrame:
    """`q` (place in `texts`), doc_id and score of the best documents of each text."""
    spark = docs.sparkSession
    vocabulary, terms_of = query_terms(texts)
    size = len(vocabulary)

    def counter():
        def count(column):
            n_terms, _, term, _ = term_counts(column, vocabulary)
            out = np.zeros((2, size + 1), np.int64)
            out[0, :size] = np.bincount(term, minlength=size)[:size]
            out[0, size], out[1, size] = np.count_nonzero(n_terms), n_terms.sum()
            return out

        return count

    counts = tally(docs, [f"`{text}`"], size + 1, counter, slice_bytes=SLICE_BYTES)
    df, n_docs, n_words = counts[0, :size], int(counts[0, size]), int(counts[1, size])
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    parts, n_items = tiles(terms_of, weight), len(texts)
    model = spark.sparkContext.broadcast((vocabulary, weight, parts))

    def search(batches):
        known, weights, cut = model.value
        best = Best(n_items, k)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                score_slice(best, part.column(0), part.column(1), known, weights, cut, n_docs, n_words)
        if len(best.item):
            yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.id, mask=best.null), pa.array(best.score)], names=["q", "doc_id", "score"])

    found = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(search, "q long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    near = Window.partitionBy("q", "group").orderBy(*order)
    few = found.withColumn("group", F.spark_partition_id() % MERGES).withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k)
    every = Window.partitionBy("q").orderBy(*order)
    return few.select("q", "doc_id", "score", F.row_number().over(every).alias("rank")).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the `k` best documents of each item.

    Terms are runs of letters, digits and bytes above 0x7F, with only A-Z lowered; an
    item's terms count once.  Documents of score 0 are not ranked; equal scores go by
    doc_id (integers), null first.  Null and empty texts have no terms.  Rows of equal
    ids are documents or items of their own; equal item texts are searched once.  Other
    columns are not read; an empty table on either side gives an empty result.

    The queries come to the driver in parts of about PASS_BYTES, each part one pass over
    all documents, which are read twice a pass and never shuffled.  Terms are compared by
    64-bit hashes of their bytes and length."""
    spark = docs.sparkSession
    importable(spark)
    small_batches(spark)
    asked = items.select(F.col(f"`{item_key}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`").cast("string"), F.lit("")).alias("t")).withColumn("digest", F.sha2("t", 256))
    texts = asked.groupBy("digest").agg(F.first("t").alias("t"))
    total = texts.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n_passes = -(-total // PASS_BYTES) or 1
    out = None
    for n in range(n_passes):
        part = texts.filter(F.pmod(F.xxhash64("digest"), F.lit(n_passes)) == n) if n_passes > 1 else texts
        rows = [r["t"] for r in part.select("t").collect()]
        if not rows:
            continue
        ranked = _pass(docs, key, text, rows, k)
        names = spark.createDataFrame([(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(rows)], "q long, digest string")
        named = asked.select("item_id", "digest").join(F.broadcast(names), "digest").join(ranked, "q").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        kind = items.schema[item_key].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
