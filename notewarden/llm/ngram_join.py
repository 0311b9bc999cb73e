"""N-gram Jaccard join: near copies by exact set similarity of word shingles.

Every shingle gets a 64-bit key whose top byte is its frequency class in the
corpus, so that sorting a document's keys puts rare shingles first.  Documents with
equal sets are one class.  Two sets that are similar enough share a key among the
first few of each (prefix filter), have similar sizes (length filter), and cannot
share too little after that key (positional filter).  A sketch of each set then shows
most pairs to differ too much (see `sketches`), before any text is moved; pairs that
pass are checked by a suffix filter and then verified once on their whole sets.

Large groups of near copies do not make all their pairs: in a first round a set is
only paired with the smallest and with the most central set of its prefix key and
size band, and what is linked then is known to be one component.  The second round takes the pairs that are
not in one component yet and may still be linked (see `open_pairs`), so no link is
lost; only its links are then joined to the components of the first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import give_back, importable, packed, slices, small_batches, stored, unpack, with_arrow
from .hashing import LOWER, U64, Words, mix, ngrams, raw_bytes

SLICE = 250_000
#: Buckets in which shingle frequencies are counted; grow it with the corpus.
COUNT_BUCKETS = 1 << 20
#: Sets of a key and size band up to which its pairs are made as they are; a set meets
#: fewer others there than it has keys that its hub may lack.
SMALL_GROUP = 64
LOW = U64((1 << 56) - 1)


def shingles(data: np.ndarray, edges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 56-bit hash of each distinct shingle of each row, in order of row.

    A row of fewer words than `width`, but not none, has its whole sequence."""
    words = Words.of(LOWER[data], edges)
    hashes = words.hashes()
    grams, at = ngrams(hashes, words.row, width)
    row = words.row[at]
    for n in range(1, width):
        few = np.flatnonzero(words.counts() == n)
        if len(few):
            first = words.first[few]
            total = np.zeros(len(few), U64)
            for k in range(n):
                total += mix(hashes[first + k] + U64(n * 64 + k))
            grams, row = np.concatenate([grams, mix(total)]), np.concatenate([row, few])
    grams &= LOW
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    keep = np.append(True, (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])) if len(row) else np.zeros(0, bool)
    return row[keep], grams[keep]


def frequency_classes(docs: DataFrame, width: int, buckets: int = COUNT_BUCKETS) -> np.ndarray:
    """Class 0 to 255 of each bucket of shingles, by the logarithm of its count."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, SLICE):
                _, grams = shingles(*raw_bytes(part.column(0)), width)
                np.add.at(total, (grams % U64(buckets)).astype(np.int64), 1)
        for at in range(0, buckets, 1 << 16):
            k = np.flatnonzero(total[at : at + (1 << 16)]) + at
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k])], names=["k", "n"])
        batch = part = total = grams = None
        give_back()

    counts = docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    found = counts.select("k", F.least(F.lit(255), F.rint(6 * F.log2("n"))).cast("short").alias("class")).toArrow()
    out = np.zeros(buckets, np.uint8)
    out[found["k"].to_numpy()] = found["class"].to_numpy()
    return out


def ordered_keys(data: np.ndarray, edges: np.ndarray, width: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all rows, rare first inside each row, and where rows begin and end."""
    row, grams = shingles(data, edges, width)
    keys = (classes[(grams % U64(len(classes))).astype(np.int64)].astype(U64) << U64(56)) | grams
    order = np.lexsort((keys, row))
    return keys[order], np.searchsorted(row, np.arange(len(edges)))


def set_hash(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each row's set of keys."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys), dtype=U64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + mix(np.diff(bounds).astype(U64))).view(np.int64)


def sketches(keys: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """For each row's set of n keys at least n bits, a power of two, each the parity of
    the keys that fall on it.  Keys in only one of two sets turn one bit each, so the
    sets differ in no fewer keys than their sketches differ in bits."""
    n = np.diff(bounds)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1)))).astype(np.int64)
    starts = np.append(0, np.cumsum(bits))
    row = np.repeat(np.arange(len(n)), n)
    at = starts[row] + (keys & LOW & (bits[row] - 1).astype(U64)).astype(np.int64)
    data = np.packbits((np.bincount(at, minlength=starts[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((starts // 8).astype(np.int32)), pa.py_buffer(data)])


def may_be_similar(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether sets of n and m keys with these sketches can be similar."""
    most = n + m - 2 * -(-percent * (n + m) // (100 + percent))
    p, q = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(q) > len(p):  # the same keys on half the bits
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum()) <= most


def least_share(n: int | np.ndarray, percent: int):
    """Keys that a set of n keys must share with any similar set."""
    return (n * percent + 99) // 100


class Joiner:
    """The join over `uid, text` rows for one threshold and shingle width."""

    def __init__(self, docs: DataFrame, percent: int = 80, width: int = 5, buckets: int = COUNT_BUCKETS):
        self.spark, self.percent, self.width = docs.sparkSession, percent, width
        self.docs = docs.select("uid", "text")
        importable(self.spark)
        small_batches(self.spark)
        self.classes = self.spark.sparkContext.broadcast(frequency_classes(self.docs, width, buckets))

    def sets(self, docs: DataFrame) -> DataFrame:
        """`docs` plus n_shingles, set_id (null for an empty set) and sketch."""
        classes, width = self.classes, self.width

        def make():
            def fn(text):
                keys, bounds = ordered_keys(*raw_bytes(text), width, classes.value)
                n = np.diff(bounds)
                return [pa.array(n, pa.int64()), pa.array(set_hash(keys, bounds), pa.int64(), mask=n == 0), sketches(keys, bounds)]

            return fn

        return with_arrow(docs, ["text"], {"n_shingles": "long", "set_id": "long", "sketch": "binary"}, make, drop=("text",), slice_bytes=SLICE)

    def prefixes(self) -> DataFrame:
        """`key, set_id, n, pos`: the prefix keys of each distinct set; sets that
        recur in a batch are given once."""
        classes, width, percent = self.classes, self.width, self.percent

        def run(batches):
            for batch in batches:
                for part in slices(batch, SLICE):
                    keys, bounds = ordered_keys(*raw_bytes(part.column(0)), width, classes.value)
                    n = np.diff(bounds)
                    ids = set_hash(keys, bounds)
                    once = np.zeros(len(n), bool)
                    once[np.unique(ids, return_index=True)[1]] = True
                    take = np.where(once & (n > 0), n - least_share(n, percent) + 1, 0)
                    row = np.repeat(np.arange(len(n)), take)
                    pos = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
                    chosen = keys[bounds[:-1][row] + pos].view(np.int64)
                    for s in range(0, len(row), 50_000):
                        t = slice(s, s + 50_000)
                        yield pa.RecordBatch.from_arrays([pa.array(chosen[t]), pa.array(ids[row[t]]), pa.array(n[row[t]], pa.int32()), pa.array(pos[t], pa.int32())], names=["key", "set_id", "n", "pos"])
            batch = part = keys = bounds = n = ids = once = take = row = pos = chosen = None
            give_back()

        return self.docs.select("text").mapInArrow(run, "key long, set_id long, n int, pos int")

    def may_link(self, a: str, b: str):
        """Length and positional filter for entries a and b of one key."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        needed = F.ceil((n + m) * self.percent / (100 + self.percent))
        before = F.least(F.col(f"{a}.pos"), F.col(f"{b}.pos"))  # keys shared before this one, at most
        room = before + F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & (room >= needed)

    def begins(self, a: str, b: str):
        """What holds for entries a and b of similar sets at their first shared key:
        all that they share stands from there on."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        needed = F.ceil((n + m) * self.percent / (100 + self.percent))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & (F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos")) >= needed)

    def hub_rows(self) -> DataFrame:
        """`key, band, set_id, n, pos, sets, hub, near, mid`: each prefix entry with the smallest
        set of its key in its size band and in the band below; similar sets lie in one
        band or in neighbouring ones.  `near`: the two may be similar.  `mid` is the
        set in which the key stands first, if it may be similar: the text that others
        are copies of has no rare shingles of its own before the key.  `sets`: how many
        the key and band have.

        One shuffle by key serves all steps; their windows stream through sorted rows."""
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / self.percent))).cast("int")
        dealt = self.prefixes().repartition("key").dropDuplicates(["key", "set_id"])
        shared = dealt.withColumn("sets", F.count("*").over(Window.partitionBy("key"))).filter("sets > 1")
        sides = shared.withColumn("own", band).withColumn("band", F.explode(F.array("own", F.col("own") - 1)))
        at_home, group = F.col("own") == F.col("band"), Window.partitionBy("key", "band")
        hubs = sides.withColumns({
            "hub": F.min(F.when(at_home, F.struct("n", "set_id", "pos"))).over(group),
            "mid": F.min(F.when(at_home, F.struct("pos", "n", "set_id"))).over(group),
            "sets": F.count("*").over(group),
        }).withColumn("own", F.struct("n", "pos", "set_id"))
        rows = hubs.filter(F.col("set_id") != F.col("hub.set_id"))
        other = (F.col("mid.set_id") != F.col("set_id")) & (F.col("mid.set_id") != F.col("hub.set_id")) & self.may_link("own", "mid")
        columns = ["key", "band", "set_id", "n", "pos", "sets", F.col("hub.set_id").alias("hub"), self.may_link("own", "hub").alias("near"), F.when(other, F.col("mid.set_id")).alias("mid")]
        return stored(rows.select(*columns), "sides")

    def hub_pairs(self, rows: DataFrame) -> DataFrame:
        """`a, b, large`: each set of `rows` with its hubs and central sets; `large`: b is
        the hub of a in a group for which `open_pairs` needs what a has outside b."""
        met = rows.select(F.col("set_id").alias("a"), "hub", "sets", F.explode(F.array_compact(F.array(F.when(F.col("near"), F.col("hub")), "mid"))).alias("b"))
        return met.groupBy("a", "b").agg(F.max((F.col("b") == F.col("hub")) & (F.col("sets") > SMALL_GROUP)).alias("large"))

    def chosen(self, members: DataFrame, rows: DataFrame) -> DataFrame:
        """`set_id, uid, n, sketch`: one row of each set that meets another in `rows`."""
        met = rows.select("set_id").union(rows.select("hub")).distinct()
        found = members.filter("set_id IS NOT NULL").join(met, "set_id", "left_semi")
        return stored(found.groupBy("set_id").agg(F.min("uid").alias("uid"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")), "chosen")

    def sift(self, pairs: DataFrame, chosen: DataFrame) -> DataFrame:
        """`pairs` (a, b) plus `may`: whether their sketches let them be similar."""
        percent = self.percent
        side = lambda x: chosen.select(F.col("set_id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

        def make():
            def fn(*columns):
                return [pa.array([may_be_similar(*r, percent) for r in zip(*(c.to_pylist() for c in columns))], pa.bool_())]

            return fn

        inputs = ["sa", "sb", "na", "nb"]
        return with_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), inputs, {"may": "boolean"}, make, drop=tuple(inputs), slice_bytes=SLICE)

    def open_pairs(self, rows: DataFrame, labels: DataFrame, first: DataFrame) -> DataFrame:
        """Pairs of different components that may be linked and are not verified.

        Similar sets share a prefix key, and so a group of key and band.  A small group
        (up to SMALL_GROUP sets) makes the pairs that can begin there (`begins`).  In a
        large one there is a hub that is no larger than either.  If both were verified
        against it and they share nothing outside it, then what they share with it
        already links them both to it.  So they either share one of the first keys that
        the hub lacks (`added`), or one of them was not near the hub; only such pairs
        are made, the latter at the first key that they share."""
        of_two = rows.filter("sets > 2").drop("mid")  # a hub and one other are done
        marked = stored(of_two.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")), "marked")
        groups = marked.groupBy("key", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key", "band")
        left = stored(marked.join(stored(groups, "groups"), ["key", "band"]), "open")
        small, left = left.filter(F.col("sets") <= SMALL_GROUP), left.filter(F.col("sets") > SMALL_GROUP)
        parted = F.col("a.label") != F.col("b.label")
        few = small.alias("a").join(small.alias("b"), ["key", "band"]).filter((F.col("a.set_id") < F.col("b.set_id")) & parted & self.begins("a", "b"))
        found = self.ends(few)
        if not left.isEmpty():
            found = found.union(self.large_pairs(left, first))
        done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return found.distinct().join(done, ["a", "b"], "left_anti")

    @staticmethod
    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a.set_id", "b.set_id").alias("a"), F.greatest("a.set_id", "b.set_id").alias("b"))

    def large_pairs(self, left: DataFrame, first: DataFrame) -> DataFrame:
        """The pairs of large groups for :meth:`open_pairs`."""
        met = stored(left.filter("near").select(F.col("set_id").alias("a"), F.col("hub").alias("b"), "n", "label").distinct(), "met")
        parted = met.groupBy("b").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("b")
        met = met.join(parted, "b")
        extra = met.join(first.filter(F.col("large") & (F.size("added") > 0)).select("a", "b", "added", "inside", "outside"), ["a", "b"]).select(
            F.col("a").alias("set_id"), F.col("b").alias("hub"), "n", "label", "inside", "outside", F.posexplode("added").alias("at", "key")
        )
        extra = extra.withColumn("at_key", F.xxhash64("hub", "key")).drop("hub", "key")  # a collision is one more pair to verify
        shared = extra.groupBy("at_key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("at_key")
        extra = stored(extra.join(stored(shared, "shared"), "at_key"), "added")
        sizes = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * self.percent
        # at the first key that they share outside the hub, what follows and what lies in the hub must be enough
        room = F.least("a.inside", "b.inside") + F.least(F.col("a.outside") - F.col("a.at"), F.col("b.outside") - F.col("b.at"))
        sizes &= room >= F.ceil((F.col("a.n") + F.col("b.n")) * self.percent / (100 + self.percent))
        one = extra.alias("a").join(extra.alias("b"), "at_key").filter((F.col("a.label") < F.col("b.label")) & sizes)
        late = left.filter(~F.col("near")).alias("a").join(left.alias("b"), ["key", "band"]).filter((F.col("a.label") != F.col("b.label")) & self.begins("a", "b"))
        return self.ends(one).union(self.ends(late))

    def texts(self, chosen: DataFrame, pairs: DataFrame) -> DataFrame:
        """`set_id, packed, early`: one text of each chosen set; `early`: it is in `pairs`."""
        early = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct().withColumn("early", F.lit(True))
        wanted = chosen.select("set_id", "uid").join(early, "set_id", "left")
        # equal rows share a uid; one of them is enough, found where the join needs it
        found = packed(self.docs, "text").repartition("uid").dropDuplicates(["uid"]).join(wanted, "uid")
        return stored(found.select("set_id", "packed", "early"), "texts")

    def verify(self, pairs: DataFrame, texts: DataFrame, added: bool = False) -> DataFrame:
        """`pairs` (a, b) plus `linked`, by the suffix filter and the whole sets.

        With `added` also the keys of a that b lacks, rare first, as many as any set
        similar to a must share one of, if it shares with a no more than b does, and how
        many keys of a lie inside and outside b."""
        classes, width, percent = self.classes, self.width, self.percent
        one = pairs.join(texts.withColumnsRenamed({"set_id": "a", "packed": "pa"}), "a")
        both = one.join(texts.withColumnsRenamed({"set_id": "b", "packed": "pb"}), "b")

        def make():
            def keys_of(data: list[bytes]) -> dict[bytes, np.ndarray]:
                raw = [unpack(d) for d in data]
                edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
                keys, bounds = ordered_keys(np.frombuffer(b"".join(raw), np.uint8), edges, width, classes.value)
                return {d: keys[x:y] for d, x, y in zip(data, bounds[:-1], bounds[1:])}

            def fn(left, right):
                left, right = left.to_pylist(), right.to_pylist()
                known = keys_of(list({*left, *right}))
                if added:
                    found = [against_hub(known[x], known[y], percent) for x, y in zip(left, right)]
                    return [pa.array([f[0] for f in found], pa.bool_()), pa.array([f[1].view(np.int64) for f in found], pa.list_(pa.int64())), *(pa.array([f[k] for f in found], pa.int32()) for k in (2, 3))]
                return [pa.array([similar(known[x], known[y], percent) for x, y in zip(left, right)], pa.bool_())]

            return fn

        outs = {"linked": "boolean", "added": "array<long>", "inside": "int", "outside": "int"} if added else {"linked": "boolean"}
        return with_arrow(both, ["pa", "pb"], outs, make, drop=("pa", "pb"), slice_bytes=SLICE)


def apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of the number of keys in only one of two sorted sets, as far
    as it matters up to `most` (suffix filter: split at a middle key, add up)."""
    low = abs(len(x) - len(y))
    if depth == 0 or low > most or not len(x) or not len(y):
        return low
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    here = at < len(x) and x[at] == y[mid]
    left = apart(x[:at], y[:mid], most, depth - 1)
    if left > most:
        return left
    return left + (0 if here else 1) + apart(x[at + here :], y[mid + 1 :], most - left, depth - 1)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * shared >= percent * all, for sorted sets without repeats."""
    total = len(x) + len(y)
    needed = -(-percent * total // (100 + percent))
    if min(len(x), len(y)) < needed or apart(x, y, total - 2 * needed) > total - 2 * needed:
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int((x[at] == y).sum()) >= needed


def against_hub(x: np.ndarray, hub: np.ndarray, percent: int) -> tuple[bool, np.ndarray, int, int]:
    """Whether x and the hub are similar, the first keys of x outside the hub, and the
    numbers of keys inside and outside.

    A set similar to x shares at least `least_share` keys with it; what it cannot
    share inside the hub it must share outside, and one of these is among the first."""
    outside = x[hub[np.minimum(np.searchsorted(hub, x), len(hub) - 1)] != x]
    shared = len(x) - len(outside)
    linked = 100 * shared >= percent * (len(hub) + len(outside))
    most = max(1, least_share(len(x), percent) - shared)
    return linked, outside[: max(0, len(outside) - most + 1)], shared, len(outside)


def starred(edges: DataFrame) -> bool:
    """Whether each `a` of the edges (a > b) has one b, which is no a itself."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """`set_id, label` for every end of an `a, b` edge: the least id of its connected
    component, by alternating large and small stars.  Minima are combined on the
    map side and joined back, so that a hub is never gathered in one task."""
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if starred(now):
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small_least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(small_least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a <> b").distinct(), "edges")
    labels = now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("set_id"), "label")
    return labels.union(now.select("b", "b").distinct())


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels that :func:`components` gives for the edges of `labels` and `links`
    together, from those it gave before and the few that the links join."""
    named = lambda x: labels.select(F.col("set_id").alias(x), F.col("label").alias(f"l{x}"))
    between = links.join(named("a"), "a", "left").join(named("b"), "b", "left")
    again = stored(components(between.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))), "joined")
    moved = labels.join(again.select(F.col("set_id").alias("label"), F.col("label").alias("least")), "label", "left")
    alone = again.join(labels.select("set_id"), "set_id", "left_anti")
    return moved.select("set_id", F.coalesce("least", "label").alias("label")).unionByName(alone)


def join(docs: DataFrame, percent: int = 80, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Membership and links of near copies among `doc_id, text` rows.

    The first result has one row per document: doc_id, uid (a hash of id and text),
    n_shingles, set_id (equal sets are one class; null for an empty set), label
    (the component as a class id) and component_id, the least doc_id that links
    reach.  The second has the verified links between classes (a, b) that join
    the components.

    Null and empty texts have an empty set and are their own component; rows that
    repeat, with or without the same id, are in one class; a null doc_id takes part
    and is never the least unless it stands alone; other columns are not read."""
    keyed = with_uid(docs).select("doc_id", "uid", F.coalesce("text", F.lit("")).alias("text"))
    joiner = Joiner(keyed, percent, width)
    members = stored(joiner.sets(keyed), "members")
    rows = joiner.hub_rows()
    chosen = joiner.chosen(members, rows)
    tested = stored(joiner.sift(joiner.hub_pairs(rows), chosen).filter("may OR large").drop("may"), "tested")
    texts = joiner.texts(chosen, tested)
    first = stored(joiner.verify(tested, texts.filter("early").drop("early"), added=True), "pairs")
    links = first.filter("linked").select("a", "b")
    labels = components(links)
    pairs = stored(joiner.sift(joiner.open_pairs(rows, labels, first), chosen).filter("may").drop("may"), "open-pairs")
    ends = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    open_texts = texts.drop("early").join(stored(ends, "ends"), "set_id", "left_semi")
    more = stored(joiner.verify(pairs, stored(open_texts, "open-texts")).filter("linked").select("a", "b"), "links")
    if not more.isEmpty():
        links, labels = links.union(more), joined_labels(labels, more)
    labels = stored(labels, "labels")
    labelled = members.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    least = labelled.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"))
    placed = labelled.join(least, "label", "left")
    return placed.select("doc_id", "uid", "n_shingles", "set_id", "label", F.coalesce("least", "doc_id").alias("component_id")), links


def with_uid(docs: DataFrame) -> DataFrame:
    return docs.withColumn("uid", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """`docs` with one row of each component: the one with the least doc_id (nulls
    last; ties by hash of id and text; of equal rows one).  Documents without words
    are linked with nothing and all stay.

    Only ids of rows that go, or that occur twice, are joined to the texts."""
    columns = docs.columns
    members = stored(join(docs, percent, width)[0].select("doc_id", "uid", "label"), "members")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    best = members.filter("label IS NOT NULL").groupBy("label").agg(F.min(rank).alias("best")).select("label", F.col("best.uid").alias("kept"))
    beaten = members.join(best, "label").filter("uid <> kept").select("uid").distinct()
    twice = members.filter("label IS NOT NULL").groupBy("uid").agg(F.count("*").alias("n")).filter("n > 1").select("uid").join(beaten, "uid", "left_anti")
    twice = stored(twice, "twice")
    keyed = with_uid(docs)
    single = keyed.join(beaten.union(twice), "uid", "left_anti")
    doubled = keyed.join(twice, "uid", "left_semi").dropDuplicates(["uid"])
    return single.unionByName(doubled).select(*(F.col(f"`{c}`") for c in columns))
