"""Removal of repeated byte strings by external suffix sorting.

Only strings that can repeat are sorted.  Every window of `length` bytes has an
anchor: the place in its first bytes whose hash is least.  Equal windows have equal
anchors, so the bytes from an anchor on (its key) and the stretch of text that its
windows span (its context) tell what must be compared:

* a context that occurs twice repeats as a whole,
* a key with one context that occurs once repeats nowhere,
* the distinct contexts of all other keys are dealt to shards by key, and each
  shard is put in suffix order by induced sorting (`induced_sort`), where shared
  prefixes of `length` bytes and more show the windows that repeat,
* a key whose contexts are larger than a shard is not sorted: its windows meet by
  the hash of their `length` bytes, in as many tasks as there are.

Shards hold whole keys, so equal windows always meet in one shard, and a shard has
less than SHARD_BYTES and KEY_BYTES together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, importable, packed, slices, small_batches, stored, unpack, with_arrow
from .hashing import U64, mix, raw_bytes, rolling, span_hash
from .induced_sort import suffix_order

GRAM, KEY = 8, 64
#: Bytes of contexts after which a shard ends.
SHARD_BYTES = 1_500_000
#: Largest key that a shard takes.
KEY_BYTES = 3_000_000
#: Bytes of text whose hashes a worker holds at a time.
SLICE = 250_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window, last window and anchor (places in the row), key and
    context hash of each anchor of each row of at least `length` bytes."""
    reach = length - KEY + 1  # starts of keys inside a window
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none, none
    prefix = rolling(data)
    at = np.arange(n - GRAM + 1)
    grams = span_hash(prefix, at, at + GRAM)
    place = (grams & ~U64(0xFFFFFFFF)) | at.astype(U64)  # ties: the first
    anchor = (sliding_least(place, reach) & U64(0xFFFFFFFF)).astype(np.int64)  # of the window at each place
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(anchor)]
    room = np.arange(len(anchor)) + length <= edges[1:][row]
    windows = np.flatnonzero(room)
    if not len(windows):
        return none, none, none, none, none, none
    new = np.append(True, (anchor[windows[1:]] != anchor[windows[:-1]]) | (row[windows[1:]] != row[windows[:-1]]))
    first = windows[new]
    last = windows[np.append(np.flatnonzero(new)[1:] - 1, len(windows) - 1)]
    a, r = anchor[first], row[first]
    key = span_hash(prefix, a, a + KEY)
    context = mix(span_hash(prefix, first, last + length) ^ mix((a - first).astype(U64)))
    start = edges[r]
    return r, first - start, last - start, a - start, key.view(np.int64), context.view(np.int64)


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """`uid, key, context, first, last` of each anchor of `uid, text` rows."""
    importable(docs.sparkSession)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                data, edges = raw_bytes(part.column(1))
                row, first, last, _, key, context = anchors(data, edges, length)
                for s in range(0, len(row), 20_000):
                    t = slice(s, s + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row[t])), pa.array(key[t]), pa.array(context[t]), pa.array(first[t], pa.int32()), pa.array(last[t], pa.int32())],
                        names=["uid", "key", "context", "first", "last"],
                    )
        batch = part = data = edges = row = first = last = key = context = None
        give_back()

    return docs.select("uid", "text").mapInArrow(run, "uid long, key long, context long, first int, last int")


def cut_contexts(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """`key, context, copies, body`: the text that the windows of each wanted
    context (`uid, key, context, copies, first, last`) span."""
    asked = wanted.groupBy("uid").agg(F.collect_list(F.struct("key", "context", "copies", "first", "last")).alias("asked"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, SLICE):
                rows, held = [], 0
                schema = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("copies", pa.int64()), ("body", pa.binary())])
                for data, asked_ in zip(part.column("packed").to_pylist(), part.column("asked").to_pylist()):
                    text = unpack(data)
                    for a in asked_:
                        rows.append({"key": a["key"], "context": a["context"], "copies": a["copies"], "body": text[a["first"] : a["last"] + length]})
                        held += len(rows[-1]["body"])
                        if held >= SLICE or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
        batch = part = rows = text = None
        give_back()

    return asked.join(packed(docs.select("uid", "text"), "text"), "uid").select("packed", "asked").mapInArrow(run, "key long, context long, copies long, body binary")


def repeats_in_shard(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each body, which of its windows also start elsewhere in the bodies."""
    sizes = np.array([len(b) for b in bodies])
    text = np.ones(int(sizes.sum()) + len(bodies) + 1, np.uint16)  # 1 parts bodies, 0 ends
    starts = np.append(0, np.cumsum(sizes + 1))[:-1]
    for s, b in zip(starts, bodies):
        text[s : s + len(b)] = np.frombuffer(b, np.uint8).astype(np.uint16) + 2
    text[-1] = 0
    order, shared = suffix_order(text, length)
    again = np.zeros(len(text), bool)
    hit = np.flatnonzero(shared >= length)
    again[order[hit]] = again[order[hit - 1]] = True
    return [again[s : s + n - length + 1] for s, n in zip(starts, sizes)]


def shard_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """`key, context, lo, hi`: runs of repeated windows of each context."""

    def sort_shard(rows):
        seen = {}
        for r in rows:
            seen.setdefault((r[0], r[1]), r)
        rows = list(seen.values())
        out = []
        for r, again in zip(rows, repeats_in_shard([r[3] for r in rows], length)):
            if r[2] > 1:
                again = np.ones(len(again), bool)
            out += [(r[0], r[1], int(a), int(b)) for a, b in zip(*runs_of(again))]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "context", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for r in zip(*columns):
                if size >= SHARD_BYTES and r[0] != held[-1][0]:
                    yield sort_shard(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield sort_shard(held)
        batch = columns = held = None
        give_back()

    sharded = contexts.repartition("key").sortWithinPartitions("key")
    return sharded.mapInArrow(run, "key long, context long, lo int, hi int")


def runs_of(again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turns = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
    return turns[::2], turns[1::2]


def hashed_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """`key, context, lo, hi` as of :func:`shard_ranges`, for keys of any size: equal
    windows have equal keys, so they are counted by the hash of their bytes and key.

    The windows of a context count once for each of its copies.  Counts are partial on the map side and stored, so that Spark
    splits a window that many contexts hold."""

    def windows(batches):
        for batch in batches:
            keys, names, copies = (np.array(batch.column(i)) for i in range(3))
            for i, body in enumerate(batch.column(3).to_pylist()):
                prefix, at = rolling(np.frombuffer(body, np.uint8)), np.arange(len(body) - length + 1)
                hashes = mix(span_hash(prefix, at, at + length) ^ mix(np.full(len(at), keys[i]).view(U64))).view(np.int64)
                same = lambda x: pa.array(np.full(len(at), x), pa.int64())
                yield pa.RecordBatch.from_arrays([same(keys[i]), same(names[i]), same(copies[i]), pa.array(at, pa.int32()), pa.array(hashes)], names=["key", "context", "copies", "place", "window"])

    def collapse(batches):
        for batch in batches:
            out = []
            for key, context, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                again = np.zeros(max(places) + 1, bool)
                again[places] = True
                out += [(key, context, int(a), int(b)) for a, b in zip(*runs_of(again))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "context", "lo", "hi"])

    found = stored(contexts.mapInArrow(windows, "key long, context long, copies long, place int, window long"), "windows")
    twice = stored(found.groupBy("window").agg(F.sum("copies").alias("n")).filter("n > 1").select("window"), "windows-twice")
    places = found.join(twice, "window").groupBy("key", "context").agg(F.collect_set("place").alias("places"))
    return places.mapInArrow(collapse, "key long, context long, lo int, hi int")


def repeated_ranges(docs: DataFrame, length: int = 200, largest: int = KEY_BYTES) -> DataFrame:
    """`uid, lo, hi`: byte ranges of `uid, text` rows that are covered by strings of
    `length` bytes that start at least twice in all rows; ranges may overlap.

    Hot keys: keys and contexts are counted with partial counts on the map side.
    The counts are stored before they are joined back, so that both sides of a join
    are plain inputs of it and Spark splits a hot key among tasks.  Keys with more
    than `largest` bytes of contexts take :func:`hashed_ranges`, the others
    :func:`shard_ranges`."""
    found = anchor_rows(docs, length)
    doubled = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    doubled = stored(doubled, "doubled")
    again = stored(found.join(doubled, "key"), "anchors")
    classes = again.groupBy("key", "context").agg(F.count("*").alias("copies"), F.min_by(F.struct("uid", "first", "last"), "uid").alias("at"))
    classes = stored(classes, "contexts")
    width = F.col("at.last") - F.col("at.first") + length
    mixed = stored(classes.groupBy("key").agg(F.count("*").alias("n"), F.sum(width).alias("width")).filter("n > 1").select("key", "width"), "mixed")
    wanted = lambda keys: cut_contexts(classes.join(keys.select("key"), "key").select("key", "context", "copies", "at.*"), docs, length)
    sorted_ = shard_ranges(wanted(mixed.filter(F.col("width") <= largest)), length)
    large = mixed.filter(F.col("width") > largest)
    if not large.isEmpty():
        sorted_ = sorted_.unionByName(hashed_ranges(wanted(large), length))
    whole = classes.join(mixed, "key", "left_anti").filter("copies > 1").select("key", "context", F.lit(0).alias("lo"), (F.col("at.last") - F.col("at.first") + 1).alias("hi"))
    ranges = stored(sorted_.unionByName(whole), "ranges")
    hit = again.join(ranges, ["key", "context"])
    return hit.select("uid", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") - 1 + length).alias("hi"))


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", as_text: str | None = None) -> DataFrame:
    """`docs` with `kept` (binary: the bytes that are left), `n_bytes`, `n_removed`
    and `n_spans` (maximal removed runs).  With `as_text`, what is left comes as text in
    a column of that name instead, as :func:`decoded` gives it, without workers of its own.

    Strings are judged on the input.  Null texts are empty; rows that repeat,
    with or without the same id, remove each other's text as any copies do; a table
    without repeats comes back whole; columns of these names are replaced."""
    spark = docs.sparkSession
    importable(spark)
    small_batches(spark)
    names = [c for c in docs.columns if c.lower() not in ("uid", "packed", "ranges", "kept", "n_bytes", "n_removed", "n_spans")]
    keyed = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("uid", F.xxhash64(*[f"`{f.name}`" for f in docs.schema.fields if f.name in names and f.name != text and f.dataType.typeName() not in ("map", "variant")], "body"))
    texts = keyed.select("uid", F.col("body").alias("text"))
    # rows that are equal in all columns share a uid, and give their ranges once
    ranges = repeated_ranges(texts, length).groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))

    def make():
        def fn(data, found):
            kept, sizes, gone, spans = [], [], [], []
            for z, ranges_ in zip(data.to_pylist(), found.to_pylist()):
                body = np.frombuffer(unpack(z), np.uint8)
                step = np.zeros(len(body) + 1, np.int32)
                for r in ranges_ or ():
                    step[r["lo"]] += 1
                    step[r["hi"]] -= 1
                out = np.cumsum(step)[:-1] > 0
                kept.append(body[~out].tobytes())
                sizes.append(len(body))
                gone.append(int(out.sum()))
                spans.append(int((np.diff(np.append(0, out.astype(np.int8))) == 1).sum()))
            left = strings(kept) if as_text else pa.array(kept, pa.binary())
            return [left, *(pa.array(x, pa.int64()) for x in (sizes, gone, spans))]

        return fn

    joined = packed(keyed.drop(text), "body").join(ranges, "uid", "left")
    outs = {**({as_text: "string"} if as_text else {"kept": "binary"}), "n_bytes": "long", "n_removed": "long", "n_spans": "long"}
    return with_arrow(joined, ["packed", "ranges"], outs, make, drop=("uid", "packed", "ranges"), slice_bytes=SLICE)


def strings(kept: list[bytes | None]) -> pa.Array:
    return pa.array([(b or b"").decode("utf-8", "ignore") for b in kept], pa.string())


def decoded(df: DataFrame, kept: str = "kept", out: str = "text") -> DataFrame:
    """`df` with the kept bytes as text; what is left of a character that a cut went
    through is dropped."""

    def make():
        return lambda column: [strings(column.to_pylist())]

    return with_arrow(df, [kept], {out: "string"}, make, drop=(kept,))
