"""Benchmark decontamination with an FM-index of each training shard.

A shard is a chunk of consecutive texts of a task. Its words become symbols: those of the test phrases have numbers,
every run of other words is one separator, for no phrase can reach across it. The suffix array comes from prefix
doubling to the depth of the longest phrase; the last column is kept as a wavelet matrix (one rank vector a bit), and
all phrases are searched backwards together, a vectorised rank step for each word. Occurrences are found from
sampled suffix positions by stepping back through the last column. Spans of occurrences are merged per document.

Scale: documents are read once, nothing is shuffled. The phrases are sent to the executors in blocks of at most
``block_bytes`` of item text, 40 bytes a phrase; more than one block means that many passes, whose spans are merged by
document. A shard searches only phrases all of whose words it has.

Nulls: a null or wordless text has no words and no hits; a null or wordless item is never found; repeated items count
one by one; repeated documents are each reported. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.kernel import CHUNK, NON_ALNUM, Words, chunks

WINDOW = 10
BLOCK_BYTES = 8 << 20
SAMPLE = 8
U64 = np.uint64


@dataclass
class Phrases:
    """Distinct windows of a block of items. words: sorted hashes of their words (symbol = place + 2)."""

    words: np.ndarray
    grid: np.ndarray  # a row of symbols for each phrase, right-aligned, -1 before it
    length: np.ndarray
    of_item: np.ndarray  # (phrase, item) pairs
    of_phrase: np.ndarray
    item_ids: list


def phrases(ids: list, texts: pa.Array, window: int = WINDOW) -> Phrases:
    raw_words = [Words(raw, at, NON_ALNUM) for _, _, raw, at in chunks(texts, 1 << 40)]
    if not raw_words:
        return Phrases(np.zeros(0, U64), np.zeros((0, window), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), ids)
    w = raw_words[0]
    h = w.hashes(lower=True)
    vocabulary = np.unique(h)
    symbol = np.searchsorted(vocabulary, h) + 2
    rows, items = [], []
    for i, (lo, hi) in enumerate(zip(w.bounds[:-1], w.bounds[1:], strict=True)):
        n = hi - lo
        if n:
            size = min(n, window)
            part = np.lib.stride_tricks.sliding_window_view(symbol[lo:hi], size)
            grid = np.full((len(part), window), -1, dtype=np.int32)
            grid[:, window - size :] = part
            rows.append(grid)
            items.append(np.full(len(part), i))
    if not rows:
        return Phrases(vocabulary, np.zeros((0, window), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), ids)
    grid, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pair = np.unique(np.stack([which.ravel(), np.concatenate(items)], axis=1), axis=0)
    return Phrases(vocabulary, grid, (grid >= 0).sum(axis=1), pair[:, 1], pair[:, 0], ids)


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs before place i, for arrays of c and i."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.n = bits, len(values)
        self.ranks, self.zeros = [], []
        v = values
        for k in reversed(range(bits)):
            bit = (v >> k) & 1
            ones = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            v = np.concatenate([v[bit == 0], v[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i.copy()
        for k, ones, zeros in zip(reversed(range(self.bits)), self.ranks, self.zeros, strict=True):
            bit = ((c >> k) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo = np.where(bit, zeros + lo1, lo - lo1)
            hi = np.where(bit, zeros + hi1, hi - hi1)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at place i, its rank before i)."""
        at, lo, out = i.copy(), np.zeros_like(i), np.zeros_like(i)
        for ones, zeros in zip(self.ranks, self.zeros, strict=True):
            o = ones[at]
            bit = ones[at + 1] > o
            out = out * 2 + bit
            at = np.where(bit, zeros + o, at - o)
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
        return out, at - lo


class FMIndex:
    """Of a symbol sequence whose first symbol, 0, is there once: all its rotations differ and sort as its suffixes do."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        n = len(text)
        self.n, self.sample = n, sample
        top, step = int(text.max()), 1
        # Prefix doubling; only rows whose rotations still tie are sorted again. A rank is the first row of its tie.
        order = np.argsort(text)
        sorted_ = text[order]
        new = np.append(True, sorted_[1:] != sorted_[:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        while len(slots):
            row = order[slots]
            key = rank[row] * n + rank[(row + step) % n]
            by = np.argsort(key)
            row, key = row[by], key[by]
            order[slots] = row
            new = np.append(True, key[1:] != key[:-1])
            rank[row] = slots[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))]
            slots = slots[~(new & np.append(new[1:], True))]
            step *= 2
        self.wave = WaveletMatrix(np.roll(text, 1)[order].astype(np.int64), max(1, top.bit_length()))
        self.first = np.zeros(top + 2, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.first[1:])
        self.top = top
        self.is_sampled = order % sample == 0
        self.sampled_at = np.cumsum(self.is_sampled) - 1
        self.samples = order[self.is_sampled]

    def search(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of each phrase (rows of symbols, right-aligned, -1 before)."""
        lo, hi = np.zeros(len(grid), dtype=np.int64), np.full(len(grid), self.n, dtype=np.int64)
        for j in reversed(range(grid.shape[1])):
            live = np.flatnonzero((grid[:, j] >= 0) & (lo < hi))
            if not len(live):
                continue
            c = grid[live, j]
            inside = c <= self.top
            lo[live[~inside]] = hi[live[~inside]] = 0
            live, c = live[inside], c[inside]
            both = self.wave.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.first[c] + both[: len(c)]
            hi[live] = self.first[c] + both[len(c) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by stepping back to rows whose position is sampled."""
        out, todo, row, steps = np.full(len(rows), -1, dtype=np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            known = self.is_sampled[row[todo]]
            done = todo[known]
            out[done] = self.samples[self.sampled_at[row[done]]] + steps
            todo = todo[~known]
            if len(todo):
                c, r = self.wave.access(row[todo])
                row[todo] = self.first[c] + r
                steps += 1
        return out


def search_chunk(raw: np.ndarray, at: np.ndarray, q: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For a shard: words per text; hit word numbers of each text; places in q.item_ids found in each text."""
    w = Words(raw, at, NON_ALNUM)
    docs = len(at) - 1
    none = [np.zeros(0, dtype=np.int64)] * docs
    if not len(q.grid) or not len(w.start):
        return w.counts, none, none
    h = w.hashes(lower=True)
    place = np.minimum(np.searchsorted(q.words, h), len(q.words) - 1)
    symbol = np.where(q.words[place] == h, place + 2, 0)
    cut = np.zeros(len(symbol), dtype=bool)
    cut[1:] = w.doc[1:] != w.doc[:-1]
    # Out-of-vocabulary runs collapse to one separator; a text border gets one too.
    keep = symbol > 0
    border = np.flatnonzero(keep & ((~np.concatenate([[False], keep[:-1]])) | cut))
    where = np.flatnonzero(keep)
    if not len(where):
        return w.counts, none, none
    insert = np.searchsorted(where, border)
    text = np.concatenate([[0], np.insert(symbol[where], insert, 1)])
    origin = np.concatenate([[-1], np.insert(where, insert, -1)])
    # A phrase with a word that the shard lacks can't occur; the last place stands for the -1 before short phrases.
    there = np.zeros(len(q.words) + 3, dtype=bool)
    there[text] = there[-1] = True
    possible = np.flatnonzero(there[q.grid].all(axis=1))
    if not len(possible):
        return w.counts, none, none
    index = FMIndex(text)
    lo, hi = index.search(q.grid[possible])
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return w.counts, none, none
    count = (hi - lo)[found]
    which = np.repeat(possible[found], count)
    rows = np.repeat(lo[found] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    spot = origin[index.locate(rows)]
    size = q.length[which]
    # Merge spans: a running sum of starts and ends.
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, spot, 1)
    np.add.at(edge, spot + size, -1)
    hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    hits = np.split(hit - w.bounds[w.doc[hit]], np.searchsorted(hit, w.bounds[1:-1]))
    pairs = np.unique(np.stack([w.doc[spot], which], axis=1), axis=0)
    by_phrase = np.argsort(q.of_phrase, kind="stable")
    a = np.searchsorted(q.of_phrase[by_phrase], pairs[:, 1], side="left")
    b = np.searchsorted(q.of_phrase[by_phrase], pairs[:, 1], side="right")
    d = np.repeat(pairs[:, 0], b - a)
    items = q.of_item[by_phrase][np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))]
    got = np.unique(np.stack([d, items], axis=1), axis=0)
    return w.counts, hits, np.split(got[:, 1], np.searchsorted(got[:, 0], np.arange(1, docs)))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, window: int = WINDOW):
    """Phrase sets of at most ``block_bytes`` of item text each (or one longer item), read through the driver one at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        length = len((r.text or "").encode())
        if ids and size + length > block_bytes:
            yield phrases(ids, pa.array(texts, pa.large_string()), window)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += length
    yield phrases(ids, pa.array(texts, pa.large_string()), window)


FOUND = (("n_words", pa.int64(), "long"), ("hits", pa.list_(pa.int32()), "array<int>"), ("items", pa.list_(pa.string()), "array<string>"))


def find(docs: DataFrame, q: Phrases, most: int = CHUNK) -> DataFrame:
    """The rows of docs with n_words, hits and items; those of an earlier block of phrases are added to."""
    shared = docs.sparkSession.sparkContext.broadcast(q)
    old = [f for f in docs.schema.fields if f.name not in {n for n, *_ in FOUND}]
    again = len(old) < len(docs.columns)

    def run(it):
        q = shared.value
        for b in it:
            text = b.column("text")
            for lo, hi, raw, at in chunks(text, most):
                n, hits, items = search_chunk(raw, at, q)
                part = b.slice(lo, hi - lo)
                ids = [[q.item_ids[k] for k in x] for x in items]
                if again:
                    hits = [np.union1d(x, np.array(y, dtype=np.int64)) for x, y in zip(hits, part.column("hits").to_pylist(), strict=True)]
                    ids = [x + y for x, y in zip(part.column("items").to_pylist(), ids, strict=True)]
                new = [pa.array(n, pa.int64()), pa.array([x.astype(np.int32) for x in hits], FOUND[1][1]), pa.array(ids, FOUND[2][1])]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in old], *new], [*[f.name for f in old], *[x for x, *_ in FOUND]])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in old], *[f"{n} {t}" for n, _, t in FOUND]])
    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs with n_words, hits (numbers of words inside found windows, ascending) and items (found item ids).

    Columns of docs called n_words, hits or items are replaced.
    """
    out = docs.drop(*[n for n, *_ in FOUND])
    for q in blocks(benchmark, block_bytes):
        out = find(out, q)
    return out


def without_hits(text: str, hits: list[int]) -> str:
    """The text without the given words (numbered as found) and with the runs around a cut joined by one space."""
    raw = np.frombuffer(text.encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]), NON_ALNUM)
    hit = np.zeros(len(w.start) + 1, dtype=bool)
    hit[hits] = True
    parts, at = [], 0
    starts = np.flatnonzero(hit[:-1] & ~np.concatenate([[False], hit[:-2]]))
    ends = np.flatnonzero(hit[:-1] & ~hit[1:])
    for a, b in zip(starts, ends, strict=True):
        parts.append(raw[at : w.start[a]].tobytes().decode().rstrip())
        at = int(w.end[b])
    parts.append(raw[at:].tobytes().decode().lstrip())
    return " ".join(p for p in parts if p)


def digests(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    ids = F.array_sort("items")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
