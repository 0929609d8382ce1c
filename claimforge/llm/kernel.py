"""Vectorised text kernels over Arrow string columns (numpy, no per-word Python).

A batch is cut into chunks of at most ``CHUNK`` bytes (a longer text is a chunk of its own), so that the
working memory of a task does not depend on the batch that Spark happens to send.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None
U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random value for each byte; A-Z share those of a-z where a caller asks for folding.
BYTE = mix(np.arange(1, 257, dtype=U64))
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside letters, digits and non-ASCII: [\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z have been lower-cased.
NON_ALNUM = np.ones(256, dtype=bool)
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x61:0x7B] = NON_ALNUM[0x41:0x5B] = NON_ALNUM[0x80:] = False

_powers = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = max(n + 1, CHUNK + 1)
        for name, base in (("up", _MULT), ("down", _INV)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, most: int = CHUNK):
    """(first row, last row + 1, bytes, offsets) of consecutive rows, at most ``most`` bytes unless one text is longer."""
    raw, at = string_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    tidy()


_seen = {"batches": 0}


def tidy(every: int = 8) -> None:
    """Now and then gives freed memory back to the system: a worker that is used again otherwise keeps its peak."""
    _seen["batches"] += 1
    if _seen["batches"] % every == 0:
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


class Words:
    """Words of a chunk: byte spans, the text each belongs to, and the words' range for each text."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE):
        self.raw, self.at = raw, at
        n = len(raw)
        gap = space[raw]
        first = np.zeros(n + 1, dtype=bool)
        first[at] = True
        before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        if n:
            before[1:] = gap[:-1]
            before |= first[:n]
            after[:-1] = gap[1:]
            after |= first[1:]
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        self.bounds = np.searchsorted(self.start, at)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(at) - 1), self.counts)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process."""
        n = len(self.raw)
        up, down = _power(n)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum((BYTE_LOWER if lower else BYTE)[self.raw] * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + U64(0x51ED270B))


def code_points(raw: np.ndarray) -> np.ndarray:
    """Running number of code points up to each byte offset (one longer than raw)."""
    out = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


_SHINGLE = [U64(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(words: Words, width: int = 5, short: bool = True, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of every ``width``-word shingle, in order; with ``short``, a text of fewer words has its whole sequence as one."""
    h = words.hashes(lower)
    n, counts = len(h), words.counts
    coeff = [mix(np.array([_SHINGLE[j % 5] + U64(j)], dtype=U64))[0] | U64(1) for j in range(width)]
    out = np.zeros(max(0, n - width + 1), dtype=U64)
    for j in range(width):
        out += h[j : j + len(out)] * coeff[j]
    keep = words.doc[: len(out)] == words.doc[width - 1 :] if n >= width else np.zeros(0, dtype=bool)
    first = np.flatnonzero(keep)
    value, doc = mix(out[first]), words.doc[first]
    few = np.flatnonzero((counts > 0) & (counts < width)) if short else np.zeros(0, dtype=np.int64)
    if len(few):
        extra = np.zeros(len(few), dtype=U64)
        for j in range(width - 1):
            has = counts[few] > j
            extra[has] += h[words.bounds[few[has]] + j] * coeff[j]
        extra = mix(extra ^ mix(counts[few].astype(U64)))
        value, doc, first = np.concatenate([value, extra]), np.concatenate([doc, few]), np.concatenate([first, words.bounds[few]])
        order = np.argsort(first, kind="stable")
        value, doc, first = value[order], doc[order], first[order]
    return value, doc, first


def distinct(value: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ascending within it: (values, bounds by text)."""
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[new], d[new]
    return v, np.searchsorted(d, np.arange(n_docs + 1))
