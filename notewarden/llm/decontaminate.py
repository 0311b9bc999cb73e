"""Benchmark decontamination with a positional inverted index.

Postings (term, document, position) of the terms that benchmark items use are
stored, each document's together.  Every window of an item names its rarest terms;
the lists of these few terms, adjusted by the term's offset and intersected, give
candidate alignments of item and document.  Only for these are the other terms looked
up, and runs of consecutive matches as long as a window are phrase matches.

DataFrame functions only: no Python runs on the executors."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_if_small
from .common import stored

WINDOW = 13
#: Bytes between words; A-Z are lower-cased before.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark tables, and of candidate documents, that are broadcast at most.
MAX_TERMS, MAX_CANDIDATES = 500_000, 1_000_000


def words_of(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def item_terms(items: DataFrame) -> DataFrame:
    """`item, item_id, n, j, word` for each word of `item_id, text` rows; items of the
    same id and text are one, and items without words give no row."""
    keyed = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item", F.xxhash64("item_id", "text"))
    listed = keyed.select("item", "item_id", words_of("text").alias("words")).withColumn("n", F.size("words"))
    return listed.select("item", "item_id", "n", F.posexplode_outer("words").alias("j", "word")).filter("word IS NOT NULL")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """`word, uid, pos` for each occurrence in `uid, text` rows of a word of `terms`.

    The terms' side is broadcast up to MAX_TERMS words; a larger one is joined by a
    shuffle, whose hot words Spark splits.  Stored as written, document after
    document, so nothing is sorted or shuffled for it."""
    vocabulary = broadcast_if_small(terms.select("word").distinct(), MAX_TERMS)
    tokens = docs.select("uid", F.posexplode_outer(words_of("text")).alias("pos", "word")).filter("word IS NOT NULL")
    return stored(tokens.join(vocabulary, "word").select("word", "uid", "pos"), "postings")


def term_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("word").agg(F.count("*").alias("freq"))


def anchor_terms(terms: DataFrame, counts: DataFrame, window: int, rarest: int) -> DataFrame:
    """`item, start, needed, j, word`: the `rarest` rarest places of every window of every
    item (ties: the first; all places of a shorter window).  A window with a term
    that no document has is left out."""
    known = terms.join(broadcast_if_small(counts, MAX_TERMS), "word", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    last = F.greatest(F.col("n") - window, F.lit(0))
    starts = F.sequence(F.greatest(F.col("j") - window + 1, F.lit(0)), F.least(F.col("j"), last))
    placed = known.select("item", "j", "word", "freq", F.explode(starts).alias("start"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("item", "start").orderBy("freq", "j")))
    least = ranked.filter(F.col("rank") <= rarest).withColumn("least", F.min("freq").over(Window.partitionBy("item", "start")))
    return least.filter("least > 0").select("item", "start", F.count("*").over(Window.partitionBy("item", "start")).alias("needed"), "j", "word")


def phrase_runs(index: DataFrame, terms: DataFrame, window: int = WINDOW, rarest: int = 2) -> DataFrame:
    """`uid, item, item_id, lo, hi`: maximal runs of document positions that equal as
    many consecutive item words, at least `window` or the whole of a shorter item.

    The lists of a window's `rarest` rarest terms, adjusted by their offsets, are
    intersected first; the other terms are looked up only where all of these agree,
    and only in the documents where some window's do."""
    anchors = stored(anchor_terms(terms, term_counts(index), window, rarest), "anchors")
    rare = index.join(broadcast_if_small(anchors.groupBy("item", "j", "word").agg(F.min("needed").alias("needed")), MAX_TERMS), "word")
    aligned = rare.groupBy("uid", "item", (F.col("pos") - F.col("j")).alias("shift")).agg(F.collect_set("j").alias("js"), F.min("needed").alias("needed"))
    agreed = aligned.filter(F.size("js") >= F.col("needed")).select("uid", "item", "shift", F.explode("js").alias("j"))
    starts = agreed.join(broadcast_if_small(anchors.select("item", "j", "start", "needed"), MAX_TERMS), ["item", "j"])
    candidates = stored(starts.groupBy("uid", "item", "shift", "start", "needed").agg(F.count("*").alias("found")).filter("found = needed").select("uid", "item", "shift", "start"), "candidates")
    item_words = broadcast_if_small(terms.select("item", "n", "j", "word"), MAX_TERMS)
    inside = (F.col("j") >= F.col("start")) & (F.col("j") < F.col("start") + window)
    expected = candidates.join(item_words, "item").filter(inside).select("uid", "item", "n", "shift", "j", "word", (F.col("shift") + F.col("j")).alias("pos")).filter("pos >= 0").distinct()
    chosen = index.join(broadcast_if_small(candidates.select("uid").distinct(), MAX_CANDIDATES), "uid", "left_semi").distinct()
    matched = expected.join(chosen, ["uid", "pos", "word"])
    run = F.col("j") - F.row_number().over(Window.partitionBy("uid", "item", "shift").orderBy("j"))
    runs = matched.withColumn("run", run).groupBy("uid", "item", "n", "shift", "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    named = broadcast_if_small(terms.select("item", "item_id").distinct(), MAX_TERMS)
    return runs.filter(F.col("hi") - F.col("lo") + 1 >= F.least(F.col("n"), F.lit(window))).join(named, "item").select("uid", "item", "item_id", "lo", "hi")


def proximity_matches(index: DataFrame, terms: DataFrame, rarest: int = 3, slop: int = 20) -> DataFrame:
    """`uid, item_id, lo, hi`: places where the `rarest` rarest terms of an item (or
    all of a shorter one) stand in any order within `slop` words: for each place of
    the rarest term the narrowest span that holds it and all others (ties: the first).

    Positions meet by buckets of `slop` words and their neighbours, so a long document
    makes no pairs of places that are far apart.  A place has fewer than 2 * slop near
    ones; each of them, and the place itself, is tried as the left end, with the first
    place of every other term at or after it."""
    counts = terms.select("item", "item_id", "word").distinct().join(broadcast_if_small(term_counts(index), MAX_TERMS), "word", "left")
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("freq", F.lit(0)), "word"))).filter(F.col("rank") <= rarest)
    ranked = ranked.withColumn("needed", F.count("*").over(Window.partitionBy("item")))
    lists = index.join(broadcast_if_small(ranked.select("item", "item_id", "word", "rank", "needed"), MAX_TERMS), "word").distinct()
    bucket = F.floor(F.col("pos") / slop)
    head = lists.filter("rank = 1").select("uid", "item", "item_id", "needed", F.col("pos").alias("at"), bucket.alias("bucket"))
    near = lists.filter("rank > 1").select("uid", "item", "pos", "rank", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    alone = head.filter("needed = 1").select("uid", "item_id", F.col("at").alias("lo"), F.col("at").alias("hi"))
    close = head.filter("needed > 1").join(near, ["uid", "item", "bucket"]).filter(F.abs(F.col("pos") - F.col("at")) < slop)
    placed = close.groupBy("uid", "item", "item_id", "needed", "at").agg(F.collect_list(F.struct("rank", "pos")).alias("others"))
    firsts = lambda lo: F.transform(
        F.sequence(F.lit(2), F.col("needed").cast("int")), lambda k: F.array_min(F.transform(F.filter("others", lambda o: (o["rank"] == k) & (o["pos"] >= lo)), lambda o: o["pos"]))
    )
    spans = F.transform(
        F.filter(F.array_distinct(F.concat(F.array("at"), F.col("others.pos"))), lambda lo: lo <= F.col("at")),
        lambda lo: F.when(F.forall(firsts(lo), lambda p: p.isNotNull()), F.greatest(F.col("at"), F.array_max(firsts(lo))) - lo),
    )
    lefts = F.filter(F.array_distinct(F.concat(F.array("at"), F.col("others.pos"))), lambda lo: lo <= F.col("at"))
    best = F.array_min(F.filter(F.zip_with(spans, lefts, lambda w, lo: F.struct(w.alias("width"), lo.alias("lo"))), lambda s: s["width"] < slop))
    found = placed.withColumn("best", best).filter("best IS NOT NULL")
    return found.select("uid", "item_id", F.col("best.lo").alias("lo"), (F.col("best.lo") + F.col("best.width")).alias("hi")).union(alone).distinct()


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` (any columns, with doc_id and text) plus n_words, n_hit, item_ids (the
    sorted ids, as strings, of items with occurring windows) and contaminated:
    at least one hit word, and at least one in twenty.

    Null and empty texts have no words and no hits; items without words match
    nothing; a null item_id counts as hits but is not listed; rows that repeat are
    marked alike; columns of these names are replaced."""
    made = ("uid", "n_words", "n_hit", "item_ids", "contaminated")
    names = [c for c in docs.columns if c.lower() not in made]
    keyed = docs.select(*(F.col(f"`{c}`") for c in names)).withColumn("uid", F.xxhash64("doc_id", "text"))
    terms = stored(item_terms(items), "terms")
    index = build_index(keyed.select("uid", "text"), terms)
    runs = stored(phrase_runs(index, terms, window), "runs")
    hits = runs.select("uid", F.explode(F.sequence("lo", "hi")).alias("pos")).distinct().groupBy("uid").agg(F.count("*").alias("n_hit"))
    listed = runs.groupBy("uid").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = hits.join(listed, "uid")
    counted = keyed.withColumn("n_words", F.size(words_of("text")).cast("long"))
    marked = counted.join(found, "uid", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    marked = marked.withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return marked.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("uid")
