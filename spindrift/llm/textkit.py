"""Vectorised text primitives shared by the corpus operators.

Words are hashed without building Python strings: a polynomial prefix sum over the bytes of a
chunk gives the hash of every byte range in it by one subtraction, so tokenising and hashing
costs a few nanoseconds a byte.  All hashes are 64 bit and depend on the bytes alone, never on
the process, so they agree between executors and between runs.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

MULT = 0x9E3779B97F4A7C15
INV = pow(MULT, -1, 1 << 64)
CHUNK = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _byte_table() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=_U) * _U(MULT))


def ascii_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def class_space_delimited() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, dtype=bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def class_alnum() -> np.ndarray:
    """Word bytes: ASCII letters and digits and every byte from 0x80."""
    t = np.zeros(256, dtype=bool)
    t[48:58] = t[65:91] = t[97:123] = True
    t[128:] = True
    return t


def powers(n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MULT and of its inverse, kept in ``cache``."""
    if cache.get("n", 0) < n:
        size = max(n, CHUNK + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("p", MULT), ("q", INV)):
                a = np.full(size, _U(base), dtype=_U)
                a[0] = 1
                cache[name] = np.cumprod(a, dtype=_U)
        cache["n"], cache["t"] = size, _byte_table()
    return cache["p"], cache["q"]


class Hasher:
    """Tokens of byte buffers and their hashes.  One per task; holds the power tables."""

    def __init__(self, word_class: np.ndarray, lower: bool = True):
        self.is_word, self.lower, self.cache = word_class, lower, {}
        self.fold = ascii_lower() if lower else None

    def prefix(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums S (one longer than data) and inverse powers Q: hash of [a,b) is (S[b]-S[a])*Q[a]."""
        p, q = powers(len(data) + 1, self.cache)
        s = np.zeros(len(data) + 1, dtype=_U)
        with np.errstate(over="ignore"):
            np.cumsum(self.cache["t"][data] * p[: len(data)], dtype=_U, out=s[1:])
        return s, q

    def spans(self, data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start and end offsets of the words; no word crosses an offset listed in ``breaks``."""
        w = self.is_word[data]
        if not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = w.copy()
        first[1:] &= ~w[:-1]
        last = w.copy()
        last[:-1] &= ~w[1:]
        if breaks is not None and len(breaks):
            b = breaks[(breaks > 0) & (breaks < len(w))]
            first[b] = w[b]
            last[b - 1] = w[b - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self, data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, hashes) of the words of one text of any length, worked in pieces cut at word ends."""
        if self.lower:
            data = self.fold[data]
        starts, ends = self.spans(data, breaks)
        out = np.empty(len(starts), dtype=_U)
        i = 0
        while i < len(starts):
            base = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
            s, q = self.prefix(data[base : ends[j - 1]])
            a, b = starts[i:j] - base, ends[i:j] - base
            with np.errstate(over="ignore"):
                out[i:j] = mix((s[b] - s[a]) * q[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))
            i = j
        return starts, ends, out


def unspaced(data: np.ndarray) -> np.ndarray | None:
    """Offsets around each character of a script written without spaces in a UTF-8 text; such a character is a word."""
    if not len(data) or data.max() < 0xE0:
        return None
    a, b = data, np.append(data[1:], 0)
    between = lambda lead, low, high: (a == lead) & (b >= low) & (b <= high)
    # Thai and Lao, Burmese, Khmer; Chinese and Japanese from U+2E80 to U+9FFF, compatibility forms, beyond the base plane
    three = between(0xE0, 0xB8, 0xBB) | between(0xE1, 0x80, 0x82) | between(0xE1, 0x9E, 0x9F) | between(0xE2, 0xBA, 0xBF) | (a >= 0xE3) & (a <= 0xE9) | between(0xEF, 0xA4, 0xAB)
    at3, at4 = np.flatnonzero(three), np.flatnonzero(between(0xF0, 0xA0, 0xB3))
    return np.unique(np.concatenate([at3, at3 + 3, at4, at4 + 4]))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is one."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    with np.errstate(over="ignore"):
        h = words[: n - width + 1].copy()
        for i in range(1, width):
            h = mix(h * _U(MULT) + words[i : n - width + 1 + i] + _U(i))
        if n < k:
            h = mix(h + _U(0xA5A5A5A5) * _U(n))
    return np.unique(h)


def texts(col: pa.Array | pa.ChunkedArray):
    """Each text's UTF-8 bytes as a uint8 array; null gives an empty one."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    big = pa.types.is_large_string(col.type)
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    null = np.asarray(col.is_null()) if col.null_count else None
    empty = np.zeros(0, np.uint8)
    for i in range(len(col)):
        yield empty if null is not None and null[i] else data[off[i] : off[i + 1]]


def pieces(batches, rows: int = 1024):
    """The batches cut to ``rows`` rows at most, which bounds what a task holds as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
