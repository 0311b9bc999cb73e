"""Lines that several documents share stay in one of them only.

DataFrame functions alone.  Lines are exploded to narrow rows of hashes, documents
are counted per hash, and the places of the lines to drop go back to their
documents, which are put together again by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

#: White space at the ends of a line that does not count.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fewer keys than this can each hold more than one part in HOT_KEYS of the shared lines: the bound of the broadcast.
HOT_KEYS = 2000
#: Parts into which the lines of such a key are dealt.
SALTS = 64


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(docs: DataFrame, min_chars: int, placed: bool) -> DataFrame:
    """`h1`, `h2` (two independent 64-bit hashes of the key), `k` and, if `placed`,
    the text's hash and the line's position, for every line long enough to count."""
    items = F.split("t", "\n", -1)
    rows = docs.select("k", "th", F.posexplode(items).alias("pos", "line")) if placed else docs.select("k", F.explode(items).alias("line"))
    keyed = rows.withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= min_chars)
    keep = ["k", "th", "pos"] if placed else ["k"]
    return keyed.select(*keep, F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))


def shared_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Hashes of the lines in `min_docs` or more documents, with the least document
    and the number of lines.  Two or more documents are there when the least and the
    greatest differ, which is added up before the shuffle; other thresholds count
    distinct documents."""
    known = F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("k"))
    least, n = F.min(known).alias("least"), F.count(F.lit(1)).alias("n")
    lines = _lines(docs, min_chars, placed=False)
    if min_docs <= 2:
        counted = lines.groupBy("h1", "h2").agg(least, F.max(known).alias("most"), n)
        wide = counted if min_docs < 2 else counted.filter(~F.col("least").eqNullSafe(F.col("most")))
    else:
        counted = lines.groupBy("h1", "h2", "k").agg(n).groupBy("h1", "h2").agg(least, F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))
        wide = counted.filter(F.col("n_docs") >= min_docs)
    return wide.select("h1", "h2", F.col("least.k").alias("first"), "n")


def _without(lines: Column, cuts: Column) -> Column:
    """The items of `lines` but those at the sorted positions `cuts`: the slices between them."""
    starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c + 1))
    ends = F.concat(cuts, F.array(F.size(lines)))
    return F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.slice(lines, x["a"] + 1, x["b"] - x["a"])))


def drop_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """`docs` with `n_lines`, `n_dropped` and `kept` (the text without dropped lines).

    A line's key (`line_key`) of at least `min_chars` code points that `min_docs` or
    more documents hold loses all its lines except in the document of the least `key`.
    Null and empty texts are one empty line.  Rows of one `key` are one document for
    the count, each with its own text; a null `key` is a document after all others.
    Columns named n_lines, n_dropped or kept are replaced, all others stay; an empty
    table gives an empty one.  A key that many documents hold is dealt over SALTS
    parts; the list of such keys is broadcast and has fewer than HOT_KEYS rows."""
    spark = docs.sparkSession
    new = {"n_lines", "n_dropped", "kept"}
    rest = [c for c in docs.columns if c.lower() not in new]
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")
    ).withColumn("th", F.xxhash64("t"))
    shared = stored(shared_lines(packed, min_chars, min_docs), "shared-lines")
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_KEYS > F.lit(total)
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = shared.select("h1", "h2", "first", F.explode(salts).alias("salt"))
    marks = F.broadcast(shared.filter(hot).select("h1", "h2", F.lit(True).alias("hot")))
    lines = _lines(packed, min_chars, placed=True).join(marks, ["h1", "h2"], "left")
    salted = lines.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("th", "pos", "k"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    gone = salted.join(dealt, ["h1", "h2", "salt"]).filter(~F.col("k").eqNullSafe(F.col("first")))
    cuts = gone.groupBy(F.col("k").alias("ck"), F.col("th").alias("cth")).agg(F.array_sort(F.collect_set("pos")).alias("cuts"))
    back = packed.join(cuts, F.col("k").eqNullSafe(F.col("ck")) & (F.col("th") == F.col("cth")), "left")
    lines_of = F.split("t", "\n", -1)
    return back.select(
        "row.*",
        F.size(lines_of).cast("long").alias("n_lines"),
        F.coalesce(F.size("cuts"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("cuts").isNull(), F.col("t")).otherwise(F.array_join(_without(lines_of, F.col("cuts")), "\n")).alias("kept"),
    )
