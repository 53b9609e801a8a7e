"""Vectorised helpers that run inside Spark tasks on the columns of one Arrow batch.

All of them work on the concatenated values of a batch (one flat array plus the offsets of
its rows), so their cost doesn't depend on how many rows a batch has.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 18
_rng = np.random.default_rng(20240501)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: By two neighbouring bytes.
PAIR_VALUES = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {}

SPACE = np.ones(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words where case and punctuation don't count: digits, lower-case letters, all of non-ASCII.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n, modulo 2**64."""
    if not _powers or len(_powers["up"]) <= n:
        m = max(n + 1, 2 * BLOCK)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(m, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def pair_values(x: np.ndarray) -> np.ndarray:
    """A random-looking value of each two neighbours of bytes, or of 64-bit values."""
    if x.dtype == np.uint8:
        return PAIR_VALUES[x[:-1].astype(np.uint16) << 8 | x[1:]]
    return mix(x[:-1] * U(0xA24BAED4963EE407) + mix(x[1:]))


class Hashes:
    """Hashes of any spans (of one element or more) of bytes or 64-bit values, equal for equal spans wherever they are.

    A polynomial of the values of neighbouring pairs. A polynomial of the elements alone, modulo 2**64, would be the same
    for a Thue-Morse sequence of 1024 elements and its complement."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        up, self.down = powers(n)
        self.sums = np.zeros(max(n, 1), dtype=np.uint64)
        if n > 1:
            np.cumsum(pair_values(x) * up[: n - 1], out=self.sums[1:])
        self.last = BYTE_VALUES[x] if x.dtype == np.uint8 else x * U(0xC2B2AE3D27D4EB4F)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end - 1] - self.sums[start]) * self.down[start] + self.last[end - 1])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.last) - k + 1
        return mix((self.sums[k - 1 :] - self.sums[:n]) * self.down[:n] + self.last[k - 1 :])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the rows' offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def small(batches: Iterator[pa.RecordBatch], column: int | str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about size bytes of text (a longer text is alone), as arrays over a batch's words take many times its bytes."""
    for b in batches:
        _, offs = text_bytes(b.column(column))
        a = 0
        while a < b.num_rows:
            to = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
            yield b.slice(a, to - a)
            a = to
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Python workers stay, and what they keep is missing to the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, and the index of each row's first word."""
    inside = is_word[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[(offs > 0) & (offs < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ascending, disjoint byte spans, block by block."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, side="right")))
        a = int(start[i])
        out[i:j] = Hashes(data[a : end[j - 1]]).spans(start[i:j] - a, end[i:j] - a)
        i = j
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., then the same for the others."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, length)


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, np.clip(start, 0, n), 1)
    np.add.at(steps, np.clip(end, 0, n), -1)
    return np.cumsum(steps[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1, *, most: int = 0, same: str = "") -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows regrouped so that none splits a group of sorted keys, and where groups begin (with the end); least rows at a time if there are so many.

    If most and same are given, of a group of more than most rows the part read so far is given, and the first row of its last value of same again with the next."""
    rest: pa.Table | None = None

    def cuts(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = np.any([(x := t.column(c).to_numpy())[1:] != x[:-1] for c in keys], axis=0)
        return np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        rest = t
        if t.num_rows < least:
            continue
        c = cuts(t)
        if len(c) > 2:
            yield t.slice(0, c[-2]).combine_chunks(), c[:-1]
            rest = t.slice(c[-2])
        elif most and t.num_rows > most:
            t = t.combine_chunks()
            yield t, c
            last = pc.index(t.column(same), t.column(same)[-1]).as_py()
            rest = t.slice(last, 1)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), cuts(rest)
    give_back()
