"""Hashes of neighbouring name tokens, for whole batches of texts at once.

The tokens are those of ``names.NAME_TOKEN`` on folded text: runs of a-z, and each
accented letter by itself."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer text is a slice of its own.
SLICE_BYTES = 250_000
BASE, MIX, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b)])) for b in (BASE, INVERSE))


def _tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the tokens; no token reaches over one of ``starts``."""
    low = FOLD[data]
    letter = (low >= 97) & (low <= 122)
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    cut = starts[(starts > 0) & (starts < len(data))]
    first[cut] |= letter[cut]
    last[cut - 1] |= letter[cut - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # hash of a run: its part of the running sum, moved to place 0
    powers, back = _powers(1 << len(data).bit_length())
    total = np.concatenate([[np.uint64(0)], np.cumsum(np.where(letter, low, 0).astype(np.uint64) * powers[: len(data)], dtype=np.uint64)])
    runs = (total[end] - total[begin]) * back[begin]
    # accented letters are two bytes, C3 and one more; the capital Y with two dots is C5 B8
    lead = np.flatnonzero((data[:-1] == 0xC3) | ((data[:-1] == 0xC5) & (data[1:] == 0xB8)))
    code = data[lead + 1].astype(np.uint64)
    code = np.where(data[lead] == 0xC5, 0xBF, np.where(code < 0x9F, code + 32, code)).astype(np.uint64)
    kept = (code >= 0x9F) & (code != 0xB7)
    place = np.concatenate([begin, lead[kept]])
    order = np.argsort(place, kind="stable")
    return place[order], _mixed(np.concatenate([runs, code[kept] + np.uint64(1 << 20)])[order])


def _slices(texts: pa.Array):
    """(number of the first text, bytes, starts of the texts in them), nulls as ''."""
    texts = texts.fill_null("").cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def pair_hash(pairs: pa.Array) -> pa.Array:
    """A hash for each string of one token, of two, or of none."""
    out = np.zeros(len(pairs), np.uint64)
    for i, data, starts in _slices(pairs):
        if not len(data):
            continue
        place, h = _tokens(data, starts)
        owner = np.searchsorted(starts, place, "right") - 1
        leads = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)]
        out[i + owner[leads]] = h[leads]
        out[i + owner[~leads]] = _mixed(out[i + owner[~leads]] + h[~leads] * SECOND)
    return pa.array(out.view(np.int64))


def holds_pair(texts: pa.Array, known: np.ndarray) -> pa.Array:
    """Whether a token of the text, or a pair of neighbours, has one of the known hashes.
    A pair of which the second token is the next text's counts too."""
    known = np.sort(known.view(np.uint64))
    out = np.full(len(texts), bool((known == 0).any()))
    low = np.zeros(1 << 24, bool)
    low[known & np.uint64((1 << 24) - 1)] = True
    for i, data, starts in _slices(texts):
        if len(data) < 2 and not len(known):
            continue
        place, h = _tokens(data, starts)
        for own, at in ((h, place), (_mixed(h[:-1] + h[1:] * SECOND), place[:-1])):
            maybe = np.flatnonzero(low[own & np.uint64((1 << 24) - 1)])
            hit = maybe[known[np.minimum(np.searchsorted(known, own[maybe]), len(known) - 1)] == own[maybe]] if len(known) else maybe
            out[i + np.searchsorted(starts, at[hit], "right") - 1] = True
    return pa.array(out)
