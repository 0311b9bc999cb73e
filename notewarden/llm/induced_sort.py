"""Suffix order and common prefixes of one shard by induced sorting.

Suffixes are of L type (larger than the next one) or S type.  The leftmost S types
are sorted first: their substrings by one induction, the string of their names by
recursion, down to a base case.  From them one scan upwards induces the L types and
one scan downwards the S types.  Both scans take suffixes from priority queues
keyed by first letter and arrival, whose tuples carry the position and the length
of the prefix shared with the entry before; a queue keeps its tuples on disk once
it is larger than its share of memory.  Common prefixes are followed to `depth`
letters.  All steps work on whole runs of queue entries."""

from __future__ import annotations

import tempfile

import numpy as np

from .hashing import U64, mix

#: Entries of a queue held in memory; the rest wait on disk.
QUEUE_ENTRIES = 4_000_000
#: Letters up to which a string is induced; larger alphabets go to the base case.
INDUCED_LETTERS = 4096
NONE = 0xFFFF
#: Positions in a shard; half the memory of 64-bit ones.
POS = np.int32


class LetterQueues:
    """A priority queue of (letter, arrival) with tuples (position, shared prefix)."""

    def __init__(self, letters: int):
        self.runs: list[list] = [[] for _ in range(letters)]
        self.held, self.disk = 0, None

    def push(self, letter: int, pos: np.ndarray, shared: np.ndarray) -> None:
        if self.held + len(pos) > QUEUE_ENTRIES:
            # spill of this task alone, gone with the file handle
            self.disk = self.disk or tempfile.TemporaryFile()
            self.disk.seek(0, 2)
            at = self.disk.tell()
            self.disk.write(pos.tobytes() + shared.tobytes())
            self.runs[letter].append((at, len(pos)))
        else:
            self.held += len(pos)
            self.runs[letter].append((pos, shared))

    def pop(self, letter: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a letter in order of arrival."""
        found = []
        for a, b in self.runs[letter]:
            if isinstance(a, int):
                self.disk.seek(a)
                found.append((np.frombuffer(self.disk.read(4 * b), POS), np.frombuffer(self.disk.read(2 * b), np.uint16)))
            else:
                self.held -= len(a)
                found.append((a, b))
        self.runs[letter] = []
        if not found:
            return np.zeros(0, POS), np.zeros(0, np.uint16)
        return np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found])


class Induction:
    """The two scans over one string; its last letter is 0 and stands only there."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth, n = text, depth, len(text)
        self.letters = int(text.max()) + 1
        ends = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
        sizes = np.diff(ends, prepend=-1)
        rising = np.append(text[ends[:-1]] < text[ends[:-1] + 1], True)
        s_type = np.repeat(rising, sizes)
        self.run = np.minimum(np.repeat(ends.astype(POS), sizes) - np.arange(n, dtype=POS) + 1, NONE).astype(np.uint16)
        self.leftmost = (np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1).astype(POS)

    def seam(self, a: int, b: int) -> int:
        """Shared prefix of an L and an S suffix of the same first letter."""
        return min(int(self.run[a]), int(self.run[b]), self.depth)

    def emit(self, queues: LetterQueues, pos: np.ndarray, shared: np.ndarray, wanted: np.ndarray, gap: np.ndarray, carry: bool) -> None:
        """Queue the wanted entries' predecessors.  gap[letter]: least shared prefix
        scanned since that letter's last entry, or NONE before its first."""
        where = np.flatnonzero(wanted)
        if carry:
            least = shared.min()
        if not len(where):
            if carry:
                gap[gap != NONE] = np.minimum(gap[gap != NONE], least)
            return
        before = self.text[pos[where] - 1]
        order = np.argsort(before, kind="stable")
        sorted_letters = before[order]
        cuts = np.append(np.flatnonzero(np.append(True, sorted_letters[1:] != sorted_letters[:-1])), len(order))
        if carry:
            old = gap.copy()
            known = gap != NONE
            gap[known] = np.minimum(gap[known], least)
        for a, b in zip(cuts[:-1], cuts[1:]):
            letter, at = int(sorted_letters[a]), where[order[a:b]]
            if carry:
                low = np.minimum.reduceat(shared[: at[-1] + 1], np.append(0, at[:-1] + 1))
                if old[letter] == NONE:
                    new = np.minimum(low + 1, self.depth).astype(np.uint16)
                    new[0] = 0
                else:
                    low[0] = min(low[0], old[letter])
                    new = np.minimum(low + 1, self.depth).astype(np.uint16)
                rest = shared[at[-1] + 1 :]
                gap[letter] = rest.min() if len(rest) else self.depth
            else:
                new = np.zeros(b - a, np.uint16)
            queues.push(letter, pos[at] - 1, new)

    def scan(self, seeds: list[tuple[np.ndarray, np.ndarray]], up: bool, carry: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """One scan over all letters.  Upwards `seeds` are the sorted leftmost S
        suffixes of each letter and the result its L suffixes; downwards seeds are
        the L suffixes and the result the S suffixes, both from high to low.
        A letter's queue comes before its seeds."""
        queues, out = LetterQueues(self.letters), [None] * self.letters
        gap = np.full(self.letters, NONE, np.uint16)
        for letter in range(self.letters) if up else range(self.letters - 1, -1, -1):
            runs, last = [], None
            while True:
                pos, shared = queues.pop(letter)
                if not len(pos):
                    break
                runs.append((pos, shared))
                before = self.text[pos - 1]
                wanted = (before >= letter) if up else (before <= letter)
                wanted &= pos > 0
                last = int(pos[-1])
                self.emit(queues, pos, shared, wanted, gap, carry)
            out[letter] = (np.concatenate([p for p, _ in runs]), np.concatenate([s for _, s in runs])) if runs else (np.zeros(0, POS), np.zeros(0, np.uint16))
            pos, shared = seeds[letter]
            if len(pos):
                shared = shared.copy()
                shared[0] = 0 if last is None else self.seam(last, int(pos[0]))
                before = self.text[pos - 1]
                wanted = ((before > letter) if up else (before < letter)) & (pos > 0)
                self.emit(queues, pos, shared, wanted, gap, carry)
        return out

    def by_letter(self, pos: np.ndarray, shared: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted suffixes dealt to their first letters."""
        first = self.text[pos]
        edges = np.searchsorted(first, np.arange(self.letters + 1))
        return [(pos[a:b], shared[a:b]) for a, b in zip(edges[:-1], edges[1:])]

    def induce(self, pos: np.ndarray, shared: np.ndarray, carry: bool) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order, each with the prefix shared with the one before,
        from the leftmost S suffixes in order."""
        low = self.scan(self.by_letter(pos, shared), True, carry)
        falling = [(p[::-1], np.append(np.uint16(0), s[::-1][:-1])) if len(p) else (p, s) for p, s in low]
        high = self.scan(falling, False, carry)
        del falling
        high[0] = (np.array([len(self.text) - 1], POS), np.zeros(1, np.uint16))
        order, lcp, at = np.empty(len(self.text), POS), np.empty(len(self.text), np.uint16), 0
        for letter in range(self.letters):
            (lp, ls), (hp, hs) = low[letter], high[letter]
            low[letter] = high[letter] = None
            order[at : at + len(lp)], lcp[at : at + len(ls)] = lp, ls
            at += len(lp)
            if len(hp):
                order[at : at + len(hp)], lcp[at + 1 : at + len(hp)] = hp[::-1], hs[::-1][:-1]
                lcp[at] = self.seam(int(lp[-1]), int(hp[-1])) if len(lp) and carry else 0
                at += len(hp)
        return order, lcp


def spans_equal(prefix: np.ndarray, powers: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of `size` letters at a and at b are equal (by 64-bit hash)."""
    return (prefix[a + size] - prefix[a]) * powers[b] == (prefix[b + size] - prefix[b]) * powers[a]


def base_order(names: np.ndarray, least_depth: int) -> np.ndarray:
    """Suffixes of a string in order of their first `least_depth` letters at least,
    by doubling; runs of equals stay in order of position."""
    rank, k, n = np.unique(names, return_inverse=True)[1].astype(np.int64), 1, len(names)
    order = np.argsort(rank, kind="stable")
    while k < least_depth and n > 1:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        k *= 2
        if k >= n or rank[order[-1]] == n - 1:
            break
    return order


def suffix_order(text: np.ndarray, depth: int, carry: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a non-empty string in order of their first `depth` letters at
    least, and the prefix each shares with the one before (followed to `depth`).

    The last letter must be 0 and stand nowhere else."""
    ind = Induction(text, depth)
    left = ind.leftmost
    if not len(left):
        left = np.array([len(text) - 1], POS)
    by_first = left[np.argsort(text[left], kind="stable")]
    rough, _ = ind.induce(by_first, np.zeros(len(left), np.uint16), carry=False)
    is_left = np.zeros(len(text), bool)
    is_left[left] = True
    sorted_left = rough[is_left[rough]]
    del rough, is_left

    keys = mix(np.arange(ind.letters).astype(U64) + U64(0x1234567))
    base = np.full(len(text) + 1, 0x9E3779B97F4A7C15, U64)
    base[0] = 1
    powers = np.cumprod(base, dtype=U64, out=base)
    prefix = np.zeros(len(text) + 1, U64)
    np.multiply(keys[text], powers[:-1], out=prefix[1:])
    np.cumsum(prefix[1:], dtype=U64, out=prefix[1:])

    size = np.zeros(len(text), POS)
    size[left] = np.append(np.diff(left), 0) + 1
    a, b = sorted_left[:-1], sorted_left[1:]
    same = size[a] == size[b]
    same[same] &= spans_equal(prefix, powers, a[same], b[same], size[a[same]])
    size = None
    named = np.zeros(len(text), POS)
    named[sorted_left] = np.cumsum(np.append(0, ~same))
    names, named = named[left], None  # the end's name is 0 and stands only there
    if not same.any():
        order = sorted_left
    else:
        if names.max() < INDUCED_LETTERS and len(names) > 1000:
            order = left[suffix_order(names, depth, carry=False)[0]]
        else:
            order = left[base_order(names, depth)]
    shared = np.zeros(len(order), np.uint16)
    if carry and len(order) > 1:
        a, b = order[:-1], order[1:]
        lo, hi = np.zeros(len(a), POS), np.minimum(depth, len(text) - np.maximum(a, b)).astype(POS)
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = spans_equal(prefix, powers, a, b, mid)
            lo = np.where(open_ & ok, mid, lo)
            hi = np.where(open_ & ~ok, mid - 1, hi)
        shared[1:] = lo
    del prefix, powers, base
    return ind.induce(order, shared, carry)
