"""Small tables and brute-force versions."""

import collections
import re

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, words=60):
    return " ".join(f"w{rng.integers(0, words)}" for _ in range(n))


def corpus(seed=5):
    """Copies, near copies, shared passages, nulls, empty, short, odd and long texts."""
    rng = np.random.default_rng(seed)
    base = [prose(rng, 120, 4000) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10 + i, base[0]) for i in range(6)]
    for i in range(12):
        words = base[1].split()
        words[int(rng.integers(0, 120))] = "changed"
        rows.append((20 + i, " ".join(words)))
    for i in range(8):  # half a text in common
        rows.append((40 + i, base[2][:330] + " " + prose(rng, 60, 4000)))
    chain = base[3].split()
    for i in range(6):  # each near the one before
        chain = chain[2:] + [f"c{i}a", f"c{i}b"]
        rows.append((50 + i, " ".join(chain)))
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "One two"), (64, "one TWO"), (65, "x"), (66, "a" * 700), (67, "ab" * 400), (68, "é🙂ß漢字 " * 90), (69, "\x00\x1f\x7f İ K"), (70, base[4] + "\n" + base[4])]
    rows += [(70, base[4] + "\n" + base[4]), (None, base[5]), (71, prose(rng, 30000, 9000))]
    return rows


def similar_components(rows, percent=80, width=5):
    sets = []
    for _, text in rows:
        w = SPACED.findall(low(text))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return [(d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def without_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((len(b), int(mask.sum()), int((np.diff(np.append(0, mask.astype(int))) == 1).sum()), kept))
    return out


def hit_words(texts, items, window=13):
    wanted = []
    for item_id, text in items:
        w = ALNUM.findall(low(text))
        k = min(window, len(w))
        wanted += [(item_id, tuple(w[i : i + k])) for i in range(len(w) - k + 1)] if k else []
    by_phrase = collections.defaultdict(set)
    for item_id, phrase in wanted:
        by_phrase[phrase].add(item_id)
    sizes = {len(p) for p in by_phrase}
    out = []
    for text in texts:
        w, hit, found = ALNUM.findall(low(text)), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                ids = by_phrase.get(tuple(w[i : i + k]))
                if ids:
                    hit.update(range(i, i + k))
                    found |= ids
        out.append((len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return out
