"""Words, shingles and window hashes of a batch of texts, computed on the batch's
bytes as a whole."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
#: Powers that a worker keeps; longer tables go when their slice is done.
KEPT_POWERS = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte but letters and digits.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: A fixed random word for each byte, so that sums over bytes mix well.
BYTE_KEYS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.int64).view(U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS["up"]) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, U64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=U64, out=steps))
    if n <= KEPT_POWERS:
        _POWERS["up"], _POWERS["down"] = made
    return made[0], made[1]


def forget_powers() -> None:
    """Let the powers go; the next task makes its own."""
    _POWERS["up"] = _POWERS["down"] = np.ones(1, U64)


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` gives the hash of any span of bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_KEYS[data] * up[:-1], dtype=U64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal spans wherever they stand; the length is mixed in."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + mix((ends - starts).astype(U64)))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins and ends (null: empty)."""
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


@dataclass
class Words:
    """Words (runs of bytes other than white space) of all rows: `start`, `end` and
    `row` of each, and `first`, the place of each row's first word."""

    data: np.ndarray
    edges: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, edges: np.ndarray, apart: np.ndarray = SPACE) -> Words:
        """`apart`: which bytes stand between words."""
        solid = ~apart[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[edges] = True
        start_mask = solid.copy()
        start_mask[1:] &= ~solid[:-1] | begins[1:-1]
        end_mask = solid.copy()
        end_mask[:-1] &= ~solid[1:] | begins[1:-1]
        start, end = np.flatnonzero(start_mask), np.flatnonzero(end_mask) + 1
        first = np.searchsorted(start, edges)
        return cls(data, edges, start, end, np.repeat(np.arange(len(edges) - 1), np.diff(first)), first)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, prefix: np.ndarray | None = None) -> np.ndarray:
        return span_hash(rolling(self.data) if prefix is None else prefix, self.start, self.end)


def ngrams(word_hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words inside a row, and the place of its first word."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(m, U64)
    for k in range(n):
        total += mix(word_hashes[k : k + m] + U64((k + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
    inside = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(total[inside]), inside


def per_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of the values in each row."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]
