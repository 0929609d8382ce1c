"""Substring dedup by compact windows: passages of ``MIN_WORDS`` words or more that occur in several documents.

1. A text is its sequence of 5-word shingles. For each of ``HASHES`` hash functions its compact windows are the nodes
   of the Cartesian tree over the hashes whose span reaches the least passage length: every subsequence between the
   bounds that holds the centre has the centre's hash as its minimum. Their centres are the minima of the sliding
   windows of that length (about two in each length), found for whole batches at once; a stack over the centres
   alone gives the spans, for the ancestors of a centre are centres too.
2. Windows with equal minima, and an equal minimum of the ``SIDE`` shingles before or after it, meet in lists: a
   shared passage reaches that far to one side of the centre, a short common line does not. Each window is joined
   with the list's first document only, so that a passage in very many documents costs a row for each. The windows of
   a document pair are the intervals in which a shared passage must lie. An equal passage collides under every hash
   function; a near one has a chance with each of them, and with each of its windows.
3. Inside those intervals the texts are compared: maximal stretches of shared shingles (gaps as far as the similarity
   allows) with at least 50 words and a Jaccard similarity of 0.8, their longest parts that have it, or 50 equal words in a row. What the
   first document of a list doesn't share is tried again with the next, for ``ROUNDS`` rounds.
4. What the lists still hold is split by a longer context: every stretch of the least length (50 words) around a centre is
   hashed, and documents with an equal one meet in a list of their own, where the first document holds what each other
   has. So every exact passage is found, whatever else shares its lists.
5. Near passages have no such context. What is still undone is held against every other document of a smaller id in its
   list: rows carry the shingles of their windows, and a pair goes on to the texts if it shares as many kinds as the
   least similar stretch has, one of them where no match lies yet, and its passages there are similar. So a near passage is
   found wherever its windows meet in a list, but where all that it shares with a keeper is reported already.

A span is reported for the later document (larger doc_id) with the document that keeps the passage; as the keeper's id
is always smaller, one copy of every passage stays.

Scale: one shuffle of windows (key, document, packed span; about 4 * HASHES / 46 of the words), small ones of
candidates, and one of the candidates' texts in each comparison: a bitmap of hashed ids of a fixed size keeps most others
back, at every size of the input. Lists are scanned as sorted streams, in partitions whose number grows with the rows. Step 5
compares in blocks of ``BLOCK`` rows of a list, so that no task holds a whole one; its work is quadratic in what a list leaves.

Nulls: null texts, rows with a null doc_id and texts under 50 words have no passages; repeated rows of one id are one
document, and repeats inside one document are left alone. Rows that repeat an id with another text are documents of their
own that come after all others (their matches carry text_hash, so that a cut touches no other row of the id). Ties (equal
passages) go to the smallest id. Very long texts: places are cut into rows of 32768 words, and a window's distances are
kept up to 65535 words; the exact split by context finds what lies beyond. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.io import among, discard, materialise, partitions
from claimforge.llm.kernel import Words, chunks, mix, shingles, string_buffers, tidy

WIDTH, MIN_WORDS, SIMILARITY, HASHES, SIDE, ROUNDS = 5, 50, 0.8, 2, 20, 2
LEAST = MIN_WORDS - WIDTH + 1  # shingles
GAP = 12  # missing shingles between shared ones of one stretch: two changed words
LATER = 1 << 62  # further texts of a repeated id are numbered from here
U64 = np.uint64
_CLIP = 0xFFFF
BLOCK, KINDS, CELLS = 2048, 4096, 1 << 20  # rows of a list, and shingles, that are compared at a time, and places of those that may be similar
_HULL = 0x8000
_TABLE, _KNOWN = 22, 1 << 14  # bits of the places for kinds of some groups; results of pairs of windows that are kept


def window_minima(packed: np.ndarray, length: int) -> np.ndarray:
    """Minimum of every ``length`` consecutive values, by doubling."""
    size, m = 1, packed
    while size * 2 <= length:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    rest = length - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def compact_windows(value: np.ndarray, doc: np.ndarray, salt: int, length: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, left, right) of the compact windows of each text's shingle sequence, as places in ``value``; bounds included."""
    n = len(value)
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    h = mix(value ^ mix(np.array([salt + 77], dtype=U64))[0])
    packed = (h & ~U64((1 << 26) - 1)) | (np.arange(n, dtype=U64) & U64((1 << 26) - 1))
    low = window_minima(packed, length)
    own = np.flatnonzero(doc[: n - length + 1] == doc[length - 1 :])
    if n <= 1 << 26:
        centre = np.unique((low[own] & U64((1 << 26) - 1)).astype(np.int64))
    else:  # one text of over 67 million words: places are looked up by window
        centre = np.unique(np.array([i + int(np.argmin(h[i : i + length])) for i in own], dtype=np.int64))
    if not len(centre):
        return centre, centre, centre
    first = np.searchsorted(doc, np.arange(int(doc[-1]) + 1))
    last = np.searchsorted(doc, np.arange(int(doc[-1]) + 1), side="right") - 1
    left, right = first[doc[centre]], last[doc[centre]]
    stack: list[int] = []
    vals, docs, places = packed[centre].tolist(), doc[centre].tolist(), centre.tolist()
    lo, hi = left.tolist(), right.tolist()
    at = -1
    for i, v in enumerate(vals):
        if docs[i] != at:
            stack, at = [], docs[i]
        while stack and vals[stack[-1]] > v:
            hi[stack.pop()] = places[i] - 1
        if stack:
            lo[i] = places[stack[-1]] + 1
        stack.append(i)
    return centre, np.array(lo), np.array(hi)


def sequence(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text) in order; the i-th shingle of a text starts at its i-th word."""
    value, doc, _ = shingles(Words(raw, at), WIDTH, short=False)
    return value, doc


def windows(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(key, doc, span, tail): the compact windows of all texts; span packs the centre and the distances to both bounds, and
    tail is the distance to the last centre of the row."""

    def run(it):
        for b in it:
            ids = b.column("doc_id")
            for lo, hi, raw, at in chunks(b.column("text")):
                value, doc = sequence(raw, at)
                begin = np.searchsorted(doc, np.arange(hi - lo))
                end = np.searchsorted(doc, np.arange(hi - lo), side="right")
                found = [compact_windows(value, doc, salt) for salt in range(hashes)]
                c, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
                if not len(c):
                    continue
                left, right = (np.concatenate([f[k] for f in found])[first] for k in (1, 2))
                low = window_minima(value, SIDE)
                at_ = c - begin[doc[c]]
                for side, near, ok in ((1, c - SIDE, c - SIDE >= begin[doc[c]]), (2, c + 1, c + SIDE < end[doc[c]])):
                    k = np.flatnonzero(ok)
                    if not len(k):
                        continue
                    key, own, place = mix(value[c[k]] ^ mix(low[near[k]] + U64(side))), doc[c[k]], at_[k]
                    # A text that repeats a line has many windows under one key: one row spans them all.
                    by = np.lexsort((place, place // _HULL, key, own))
                    k, key, own, place = k[by], key[by], own[by], place[by]
                    new = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (place[1:] // _HULL != place[:-1] // _HULL))
                    head = np.flatnonzero(new)
                    lo_, hi_ = np.minimum.reduceat(left[k], head), np.maximum.reduceat(right[k], head)
                    centre, tail = c[k[head]], place[np.append(head[1:], len(place)) - 1] - place[head]
                    span = (place[head] << 32) | (np.minimum(centre - lo_, _CLIP) << 16) | np.minimum(hi_ - centre, _CLIP)
                    yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), ids.take(pa.array(own[head] + lo)), pa.array(span), pa.array(tail.astype(np.int32))], ["key", "doc", "span", "tail"])

    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "key long, doc long, span long, tail int")


def scan_lists(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of lists behind the list's first, with it: (key, doc, span, tail, pivot, pivot_span)."""

    def run(it):
        last = None  # (key, doc, span, tail, pivot, pivot_span) of the row that ended the batch before
        for b in it:
            if not b.num_rows:
                continue
            key, doc, span, tail = (b.column(c).to_numpy() for c in ("key", "doc", "span", "tail"))
            if last is not None:
                key, doc, span, tail = (np.append(np.array([x], dtype=y.dtype), y) for x, y in zip(last[:4], (key, doc, span, tail), strict=True))
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            pivot, pivot_span = doc[lead], span[lead]
            if last is not None:
                pivot, pivot_span = np.where(lead == 0, last[4], pivot), np.where(lead == 0, last[5], pivot_span)
            keep = ~new  # also further rows of the pivot: others are compared with its first one only
            last = (key[-1], doc[-1], span[-1], tail[-1], pivot[-1], pivot_span[-1])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, doc, span, tail, pivot, pivot_span)], ["key", "doc", "span", "tail", "pivot", "pivot_span"])

    return rows.repartition(parts, "key").sortWithinPartitions("key", "doc", "span").mapInArrow(run, "key long, doc long, span long, tail int, pivot long, pivot_span long")


def _covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Places inside the windows packed in ``spans``."""
    c, left, right = spans >> 32, (spans >> 16) & _CLIP, spans & _CLIP
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.clip(c - left, 0, n), 1)
    np.add.at(edge, np.clip(c + right + 1, 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


class Sequence:
    """A text's shingles, with what comparing them with many others needs: their order by value, and where each occurred before."""

    def __init__(self, value: np.ndarray):
        self.value, self.order = value, np.argsort(value, kind="stable")
        self.sorted = value[self.order]
        self.before = _before(value, self.order)


def _before(value: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """The place before that holds the same value, or -1: a stretch from s on has as many kinds as places with one below s."""
    order = np.argsort(value, kind="stable") if order is None else order
    out = np.full(len(value), -1)
    again = np.flatnonzero(value[order[1:]] == value[order[:-1]])
    out[order[again + 1]] = order[again]
    return out


def shared_passages(x: np.ndarray | Sequence, p: np.ndarray | Sequence, x_spans: np.ndarray | None, p_spans: np.ndarray | None, among: np.ndarray | None = None) -> list[tuple[int, int, int, float]]:
    """Passages of x that p holds within the windows (None: everywhere): (first word, end word, first word in p, similarity).
    With ``among``, stretches without any of these places of x may be left out."""
    x, p = (t if isinstance(t, Sequence) else Sequence(t) for t in (x, p))
    if not len(x.value) or not len(p.value):
        return []
    order, ordered = p.order, p.sorted
    if p_spans is not None:
        inside = _covered(p_spans, len(p.value))[order]
        order, ordered = order[inside], ordered[inside]
        if not len(order):
            return []
    at = np.minimum(np.searchsorted(ordered, x.value), len(order) - 1)
    ok = ordered[at] == x.value
    if x_spans is not None:
        ok &= _covered(x_spans, len(x.value))
    # A shingle that p repeats goes with its first place in p.
    hit = np.flatnonzero(ok)
    if len(hit) < 2:
        return []
    where, out = order[at[hit]], []
    cut = np.flatnonzero(hit[1:] - hit[:-1] > GAP) + 1
    first, last = np.append(0, cut), np.append(cut, len(hit))
    long = np.flatnonzero(hit[last - 1] - hit[first] + 1 >= LEAST)
    if not len(long):
        return out
    before = _before(x.value[hit])
    for k in long.tolist():
        lo, hi = int(first[k]), int(last[k])
        s, e = int(hit[lo]), int(hit[hi - 1])
        if among is not None and not among[s : e + 1].any():
            continue
        similarity, start = _similarity(x, p, hit, where, before, lo, hi)
        if similarity >= SIMILARITY:
            out.append((s, e + WIDTH, start, similarity))
            continue
        group, spot = hit[lo:hi], where[lo:hi]
        held = np.zeros(len(group), dtype=bool)
        for i, j, similarity, start in _similar_parts(x, p, hit, where, before, lo, hi):
            out.append((int(group[i]), int(group[j]) + WIDTH, start, similarity))
            held[i : j + 1] = True
        run = np.append(0, np.flatnonzero(group[1:] - group[:-1] != 1) + 1)
        end = np.append(run[1:], len(group))
        for i, j in zip(run[end - run >= LEAST].tolist(), end[end - run >= LEAST].tolist(), strict=True):
            if not held[i:j].all():
                out.append((int(group[i]), int(group[j - 1]) + WIDTH, int(spot[i]), 1.0))
    return out


def _similarity(x: Sequence, p: Sequence, hit: np.ndarray, where: np.ndarray, before: np.ndarray, i: int, j: int) -> tuple[float, int]:
    """Jaccard similarity of the stretch of x from the first to the last of the places hit[i:j] to its counterpart in p, and where that begins."""
    s, e = int(hit[i]), int(hit[j - 1])
    kinds = int(np.count_nonzero(before[i:j] < i))
    mine = int(np.count_nonzero(x.before[s : e + 1] < s))
    lo, hi = _counterpart(hit[i:j], where[i:j])
    union = mine + int(np.count_nonzero(p.before[lo : hi + 1] < lo)) - kinds
    return kinds / max(union, 1), lo


def _counterpart(at: np.ndarray, spot: np.ndarray) -> tuple[int, int]:
    """First and last place in p of what answers to the stretch of x whose shared places ``at`` lie at ``spot`` there."""
    size = int(at[-1]) - int(at[0]) + 1
    lo, hi = int(spot.min()), int(spot.max())
    if hi - lo + 1 > 2 * size:
        lo = int(np.median(spot - at)) + int(at[0])
        hi = lo + size - 1
    return max(lo, 0), hi


def _similar_parts(x: Sequence, p: Sequence, hit: np.ndarray, where: np.ndarray, before: np.ndarray, start: int, stop_: int) -> list[tuple[int, int, float, int]]:
    """Longest parts (from, to, similarity, place in p) of the stretch hit[start:stop_] that are similar, enough of them to cover all such parts.

    A part is similar where shared shingles outweigh missing ones (of either text) by SIMILARITY : 1 - SIMILARITY, a sum
    over its steps: with a = sum up to its end and b = sum before its start, the furthest end of a start is the last a >= b.
    """
    group, spot = hit[start:stop_], where[start:stop_]
    step = spot[1:] - spot[:-1]
    missing = np.append(0, group[1:] - group[:-1] - 1 + np.where((step > 0) & (step <= GAP + 1), step - 1, 0))
    weight = round(SIMILARITY / (1 - SIMILARITY))
    place, cost = np.arange(len(group)), weight * np.cumsum(missing)
    a, b = place + 1 - cost, place - cost
    far = np.searchsorted(-np.maximum.accumulate(a[::-1])[::-1], -b, side="right") - 1
    first = np.flatnonzero((far > np.append(-1, np.maximum.accumulate(far)[:-1])) & (group[far] - group >= LEAST - 1))
    out, end, k = [], -1, 0
    while k < len(first):
        # of the parts that begin before the covered end, the furthest that passes the count of distinct shingles
        stop = max(k + 1, int(np.searchsorted(first, end + 1, side="right")))
        for m in range(stop - 1, k - 1, -1):
            i, j = int(first[m]), int(far[first[m]])
            similarity, lo = _similarity(x, p, hit, where, before, start + i, start + j + 1)
            if similarity >= SIMILARITY:
                out.append((i, j, similarity, lo))
                end = j
                break
        k = stop
    return out


MATCH = "doc_id long, start_word int, end_word int, keeper_doc_id long, keeper_start int, similarity double"


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Matches of pairs(doc, pivot, x_spans, p_spans) by the texts(doc_id, text)."""

    def sequences(t, column: str, ids: str):
        """(number of each row's sequence, the sequences), made once for equal neighbours."""
        who = t.column(ids).to_numpy()
        new = np.ones(len(who), dtype=bool)
        new[1:] = who[1:] != who[:-1]
        heads = t.column(column).take(pa.array(np.flatnonzero(new)))
        out = []
        for lo, hi, raw, at in chunks(heads):
            value, doc = sequence(raw, at)
            out += np.split(value, np.searchsorted(doc, np.arange(1, hi - lo)))
        return np.cumsum(new) - 1, out

    def matched(it):
        names = [c.split()[0] for c in MATCH.split(", ")]
        for t in it:
            if not t.num_rows:
                continue
            (gx, x), (gp, p) = sequences(t, "text_x", "doc"), sequences(t, "text_p", "pivot")
            doc, pivot, xs, ps = (t.column(c) for c in ("doc", "pivot", "x_spans", "p_spans"))
            rows = []
            for i in range(t.num_rows):
                for s, e, q, j in shared_passages(x[gx[i]], p[gp[i]], np.asarray(xs[i].values), np.asarray(ps[i].values)):
                    rows.append((doc[i].as_py(), s, e, pivot[i].as_py(), q, j))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    some = among(texts.select("doc_id", "text"), pairs.select(F.explode(F.array("doc", "pivot")).alias("doc_id")), "doc_id")

    def side(name: str, text: str) -> DataFrame:  # the same rows for both sides, which are shuffled once
        return some.select(F.col("doc_id").alias(name), F.col("text").alias(text))

    both = pairs.join(side("doc", "text_x"), "doc").join(side("pivot", "text_p"), "pivot")
    return both.select("doc", "pivot", "x_spans", "p_spans", "text_x", "text_p").mapInArrow(matched, MATCH)


def context(lists: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, doc, span): a row for each stretch of the least length around the centres of lists(doc, span, tail, need), by its
    hash; a doc whose rows need no match gives each stretch once. The lowest bit of span's left distance says "needs one"."""
    rows = lists.groupBy("doc").agg(F.collect_list(F.struct("span", "tail", "need")).alias("at"))

    def run(it):
        for b in it:
            keys, docs, spans = [], [], []
            for lo, hi, raw, at in chunks(b.column("text")):
                value, owner = sequence(raw, at)
                for i, x in enumerate(np.split(value, np.searchsorted(owner, np.arange(1, hi - lo))), start=lo):
                    own = b.column("at")[i].values
                    start, need = stretches(x, own.field("span").to_numpy(), own.field("tail").to_numpy(), own.field("need").to_numpy(zero_copy_only=False))
                    h = np.zeros(len(start), dtype=U64)
                    for j in range(LEAST):
                        h = h * U64(0x9E3779B97F4A7C15) + x[start + j]
                    once = np.zeros(len(start), dtype=bool)
                    once[np.unique(h, return_index=True)[1]] = True
                    k = np.flatnonzero(need | once)
                    keys.append(mix(h[k]).view(np.int64))
                    docs.append(np.full(len(k), b.column("doc")[i].as_py(), dtype=np.int64))
                    spans.append((start[k] << 32) | (need[k].astype(np.int64) << 16) | (LEAST - 1))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, docs, spans)], ["key", "doc", "span"])

    return rows.join(texts.withColumnRenamed("doc_id", "doc"), "doc").select("doc", "at", "text").mapInArrow(run, "key long, doc long, span long")


def stretches(x: np.ndarray, spans: np.ndarray, tail: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, needed?) of all stretches of the least length in x that have a centre of ``spans`` as their minimum."""
    n = len(x) - LEAST + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    c, left, right = spans >> 32, (spans >> 16) & _CLIP, spans & _CLIP
    lo, hi = c - np.minimum(left, LEAST - 1), c + np.minimum(right - LEAST + 1, 0) + 1
    for i in np.flatnonzero((tail > 0) & (c < len(x))):  # a row of many centres: all places of the centre's shingle
        more = c[i] + np.flatnonzero(x[c[i] : c[i] + tail[i] + 1] == x[c[i]])
        lo, hi, need = np.append(lo, more - LEAST + 1), np.append(hi, more + 1), np.append(need, np.full(len(more), need[i]))
    counts = []
    for k in (np.ones(len(lo), dtype=bool), need):
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, np.clip(lo[k], 0, n), 1)
        np.add.at(edge, np.clip(hi[k], 0, n), -1)
        counts.append(np.cumsum(edge[:-1]) > 0)
    start = np.flatnonzero(counts[0])
    return start, counts[1][start]


def undone(lists: DataFrame, matches: DataFrame) -> DataFrame:
    """lists with ``need``: no one match holds all passages of the least length around the row's centres."""
    held = matches.select(F.col("doc_id").alias("doc"), "start_word", "end_word").groupBy("doc").agg(F.collect_set(F.struct("start_word", "end_word")).alias("held"))
    centre, side = F.shiftright("span", 32), lambda bits: F.shiftright("span", bits).bitwiseAND(F.lit(_CLIP))
    lo = centre - F.least(F.lit(LEAST - 1), side(16))
    hi = centre + F.col("tail") + F.least(F.lit(LEAST - 1), F.greatest(F.lit(0), side(0) - F.col("tail"))) + WIDTH
    done = F.coalesce(F.exists("held", lambda h: (h.start_word <= lo) & (hi <= h.end_word)), F.lit(False))
    return lists.join(held, "doc", "left").withColumn("need", ~done).drop("held")


def rest(lists: DataFrame, found: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Matches of what ``found`` leaves in the lists: exact ones by context, then near ones by comparing each with all of its list."""
    rows = undone(lists, found).withColumn("need", F.col("need") & (F.col("doc") != F.col("pivot"))).select("key", "doc", "span", "tail", "need")
    rows = materialise(open_lists(rows), "passage-rest")
    split = scan_lists(context(rows.select("doc", "span", "tail", "need"), texts).withColumn("tail", F.lit(0)), parts)
    needed = F.shiftright("span", 16).bitwiseAND(F.lit(_CLIP)) > 0
    plain = lambda c: F.col(c).bitwiseAND(F.lit(~(_CLIP << 16)))
    pairs = materialise(pair_up(split.filter(needed).withColumn("span", plain("span")).withColumn("pivot_span", plain("pivot_span"))), "passage-pairs")
    exact = materialise(compare(pairs, texts), "passage-matches")
    discard(pairs)
    left = undone(rows.withColumnRenamed("need", "was"), exact).withColumn("need", F.col("need") & F.col("was")).drop("was")
    left = materialise(left, "passage-rest")
    near = materialise(pair_up(similar_rows(sequences(open_lists(left), found.unionByName(exact), texts), parts)), "passage-pairs")
    out = exact.unionByName(materialise(compare(near, texts), "passage-matches"))
    discard(rows, left, near)
    return out


def open_lists(rows: DataFrame) -> DataFrame:
    """rows of the lists in which several documents are and one of them needs a match."""
    keys = rows.groupBy("key").agg(F.max("need").alias("any"), F.min("doc").alias("a"), F.max("doc").alias("z")).filter("any AND a < z").select("key")
    return rows.join(keys, "key", "left_semi")


def sequences(rows: DataFrame, matches: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, doc, span, need, kinds, open, least) of rows(key, doc, span, tail, need): the window's shingles (32 bits of each), a
    bit for each that no match holds, and the fewest different ones in a stretch of the least length."""
    by_doc = rows.groupBy("doc").agg(F.collect_list(F.struct("key", "span", "need")).alias("at"))
    held = matches.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("held"))

    def run(it):
        for b in it:
            for lo, hi, raw, at in chunks(b.column("text")):
                value, owner = sequence(raw, at)
                out, size = [[] for _ in range(7)], 0
                for i, x in enumerate(np.split(value, np.searchsorted(owner, np.arange(1, hi - lo))), start=lo):
                    free, kinds = uncovered(len(x), b.column("held")[i].as_py() or []), stretch_kinds(x)
                    for r in b.column("at")[i].as_py():
                        c, left, right = r["span"] >> 32, (r["span"] >> 16) & _CLIP, r["span"] & _CLIP
                        s, e = max(c - left, 0), min(c + right + 1, len(x))
                        if e - s >= LEAST and (free[s:e].any() or not r["need"]):
                            row = (r["key"], b.column("doc")[i].as_py(), r["span"], r["need"], x[s:e].astype(np.uint32).tobytes(), np.packbits(free[s:e]).tobytes(), int(kinds[s : e - LEAST + 1].min()))
                            size += len(row[4])
                            for column, v in zip(out, row, strict=True):
                                column.append(v)
                        if size > 4 << 20:
                            yield batch(out)
                            out, size = [[] for _ in range(7)], 0
                if out[0]:
                    yield batch(out)

    def batch(out):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["key", "doc", "span", "need", "kinds", "open", "least"])

    joined = by_doc.join(held, "doc", "left").join(among(texts.select(F.col("doc_id").alias("doc"), "text"), rows.select("doc"), "doc"), "doc")
    return joined.select("doc", "at", "held", "text").mapInArrow(run, "key long, doc long, span long, need boolean, kinds binary, open binary, least int")


def uncovered(n: int, held: list) -> np.ndarray:
    """Which of a text's n shingles no span of ``held`` holds whole."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for h in held:
        edge[min(h["start_word"], n)] += 1
        edge[min(max(h["end_word"] - WIDTH + 1, h["start_word"]), n)] -= 1
    return np.cumsum(edge[:-1]) == 0


def stretch_kinds(x: np.ndarray) -> np.ndarray:
    """The different shingles of every stretch of the least length."""
    n = len(x) - LEAST + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    before, at = order[again], order[again + 1]  # a shingle and the one before that equals it: both in the stretches between
    near = at - before < LEAST
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, np.clip(at[near] - LEAST + 1, 0, n), 1)
    np.add.at(edge, np.clip(before[near] + 1, 0, n), -1)
    return LEAST - np.cumsum(edge[:-1])


def similar_rows(rows: DataFrame, parts: int) -> DataFrame:
    """(doc, span, pivot, pivot_span): rows of a list that need a match, with those of smaller ids that give it one where none lies."""
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("kinds")) / (4 * CELLS))
    rows = rows.join(rows.groupBy("key").agg(F.ceil(size).cast("int").alias("blocks")), "key").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    # A row goes to the groups (x, p) of its block, to seek as one of x or to be held against as one of p; once, where it is both.
    other, none = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.lit(None).cast("binary")
    some = ("doc", "span", "kinds", "least")
    hold = rows.withColumn("other", other).withColumn("seeks", F.col("need") & (F.col("other") == F.col("own")))
    hold = hold.select("key", F.col("other").alias("x"), F.col("own").alias("p"), "seeks", F.lit(True).alias("holds"), *some, F.when(F.col("seeks"), F.col("open")).alias("open"))
    seek = rows.filter("need AND blocks > 1").withColumn("other", other).filter("other <> own")
    seek = seek.select("key", F.col("own").alias("x"), F.col("other").alias("p"), F.lit(True).alias("seeks"), F.lit(False).alias("holds"), *some, "open")
    names = ("key", "x", "p", "seeks", "holds", "doc", "span", "least")

    def run(it):
        cols, kinds, free, shingles = None, [], [], 0
        for b in it:
            if not b.num_rows:
                continue
            own = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            cols = own if cols is None else [np.concatenate(c) for c in zip(cols, own, strict=True)]
            kinds += [np.frombuffer(k, np.uint32) for k in b.column("kinds").to_pylist()]
            free += [f and np.unpackbits(np.frombuffer(f, np.uint8)).astype(bool) for f in b.column("open").to_pylist()]
            shingles += sum(len(k) for k in kinds[-b.num_rows :])
            new = np.append(True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0))
            hi = int(np.flatnonzero(new)[-1])
            if shingles >= CELLS and hi:  # the last group may go on
                yield from pairs_of(similar_in(np.cumsum(new[:hi]), *(c[:hi] for c in cols[3:]), kinds[:hi], free[:hi]))
                cols, kinds, free = [c[hi:] for c in cols], kinds[hi:], free[hi:]
                shingles = sum(len(k) for k in kinds)
                tidy()
        if cols is not None:
            new = np.append(True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0))
            yield from pairs_of(similar_in(np.cumsum(new), *cols[3:], kinds, free))

    def pairs_of(found):
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc", "span", "pivot", "pivot_span"])

    dealt = hold.unionByName(seek).repartition(parts, "key", "x", "p").sortWithinPartitions("key", "x", "p", "doc", "span")
    return dealt.mapInArrow(run, "doc long, span long, pivot long, pivot_span long")


def similar_in(group: np.ndarray, seeks: np.ndarray, holds: np.ndarray, doc: np.ndarray, span: np.ndarray, least: np.ndarray, kinds: list, free: list) -> list[tuple[int, int, int, int]]:
    """(doc, span, pivot, pivot_span) of groups, each in the order of doc: for each seeking row, the holding ones of smaller ids that
    share a similar passage which is in part open to it; what one gives is no longer open to the next.

    First every seeking row is held against all that any row of a smaller id has; only what may be similar to that is compared by row.
    """
    out: list[tuple[int, int, int, int]] = []
    xs = np.flatnonzero(seeks)
    if not len(xs) or not holds.any():
        return out
    lengths = np.array([len(k) for k in kinds])
    value, row = np.concatenate(kinds), np.repeat(np.arange(len(kinds)), lengths)
    bounds = np.append(0, np.cumsum(lengths))
    # a place of a table for each kind in each group; kinds that meet in one only let more pass
    slot = (value ^ (group.astype(np.uint32) * np.uint32(0x9E3779B1))[row]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - _TABLE)
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])))
    rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc)))).astype(np.int32)  # of the document
    earliest = np.full(1 << _TABLE, len(doc), dtype=np.int32)
    back = np.flatnonzero(holds[row])[::-1]
    earliest[slot[back]] = rank[row[back]]  # the last one written is the first document
    at = np.flatnonzero(seeks[row])
    held = earliest[slot[at]] < rank[row[at]]
    open_ = np.concatenate([free[i][: lengths[i]] for i in xs])
    few = np.add.reduceat(held, np.append(0, np.cumsum(lengths[xs])[:-1])) < np.ceil(SIMILARITY * least[xs] - 1e-9)
    held &= ~np.repeat(few, lengths[xs])
    may = np.zeros(len(value), dtype=bool)
    may[at] = similar_places(value[at], held, row[at])
    fresh = np.zeros(len(value), dtype=bool)
    fresh[at] = may[at] & open_
    left = xs[np.add.reduceat(fresh[at], np.append(0, np.cumsum(lengths[xs])[:-1])) > 0]
    if not len(left):
        return out
    wanted = np.zeros(1 << _TABLE, dtype=bool)
    keep = np.zeros(len(kinds), dtype=bool)
    keep[left] = True
    wanted[slot[may & keep[row]]] = True
    use = wanted[slot] & holds[row]
    edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    for n in np.unique(np.searchsorted(edges, left, side="right") - 1).tolist():
        lo, hi = int(edges[n]), int(edges[n + 1])
        span_of = slice(bounds[lo], bounds[hi])
        mine = left[(left >= lo) & (left < hi)]
        out += _similar_to(mine, lo, hi, holds, doc, span, least, kinds, free, bounds, may, fresh, value[span_of][use[span_of]], row[span_of][use[span_of]])
    return out


def _similar_to(xs, lo, hi, holds, doc, span, least, kinds, free, bounds, may, fresh, value, row) -> list[tuple[int, int, int, int]]:
    """The pairs of similar_in in the group of rows lo to hi for its seeking rows ``xs``; (value, row) are the kinds that may count."""
    out, known, numbers = [], {}, {}
    same = np.array([numbers.setdefault(k.tobytes(), len(numbers)) for k in kinds[lo:hi]])  # equal windows have one number
    ps = lo + np.flatnonzero(holds[lo:hi])
    ps = ps[np.sort(np.unique(same[ps - lo], return_index=True)[1])]  # what the first of equal windows doesn't give, no other does
    place = np.full(hi - lo, -1)
    place[ps - lo] = np.arange(len(ps))
    row = place[row - lo]
    value, row = value[row >= 0], row[row >= 0]
    both = np.unique((value.astype(U64) << U64(32)) | row.astype(U64))
    value, row = (both >> U64(32)).astype(np.uint32), (both & U64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, dtype=np.int64)
    names, head = value[head], np.append(head, len(value))

    def holders(some: np.ndarray) -> np.ndarray:
        """How many of the kinds each of ps has."""
        total = np.zeros(len(ps), dtype=np.int64)
        some = np.unique(some)
        c = np.searchsorted(names, some)
        c = c[names[np.minimum(c, len(names) - 1)] == some] if len(names) else c[:0]
        sizes = np.diff(head)[c]
        step = max(1, CELLS // len(ps))
        for k in range(0, len(c), step):
            n = sizes[k : k + step]
            ends = np.cumsum(n)
            total += np.bincount(row[np.arange(int(ends[-1])) + np.repeat(head[c[k : k + step]] - ends + n, n)], minlength=len(ps))
        return total

    made: dict[int, Sequence] = {}

    def sequence_of(i: int) -> Sequence:
        if (n := int(same[i - lo])) not in made:
            if len(made) >= _KNOWN // 16:
                made.clear()
            made[n] = Sequence(kinds[i])
        return made[n]

    for at in xs.tolist():
        x, own = kinds[at], slice(bounds[at], bounds[at + 1])
        still = free[at][: len(x)].copy()
        near = np.flatnonzero((doc[ps] < doc[at]) & (holders(x[may[own]]) >= np.ceil(SIMILARITY * least[at] - 1e-9)))
        if len(near):
            near = near[holders(x[fresh[own]])[near] > 0]
        step, most = 4, max(1, CELLS // (8 * len(x)))
        while len(near):
            some, near = near[:step], near[step:]
            for n in np.flatnonzero(may_give(x, [kinds[k] for k in ps[some]], still, lambda n, some=some: sequence_of(int(ps[some[n]])))).tolist():
                new, other = False, ps[some[n]]
                pair = (same[at - lo], same[other - lo], still.tobytes())
                if pair not in known:
                    if len(known) >= _KNOWN:
                        known.clear()
                    known[pair] = shared_passages(sequence_of(at), sequence_of(other), None, None, still)
                for s, e, _, _ in known[pair]:
                    new |= bool(still[s : e - WIDTH + 1].any())
                    still[s : e - WIDTH + 1] = False
                if new:  # only what holds something still open goes on
                    out.append((int(doc[at]), int(span[at]), int(doc[other]), int(span[other])))
                    near = np.append(some[n + 1 :], near)
                    near = near[holders(x[fresh[own] & still])[near] > 0] if len(near) else near
                    break
            step = min(4 * step, most)
    return out


def similar_places(x: np.ndarray, hit: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The places that may_hold gives for rows of shingles one behind the other, by what each holds of its row."""
    out = np.zeros(len(x), dtype=bool)
    at = np.flatnonzero(hit)
    if not len(at):
        return out
    cut = np.flatnonzero((np.diff(at) > GAP + 1) | (row[at[1:]] != row[at[:-1]])) + 1
    s, e = at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)] + 1
    s, e = s[e - s >= LEAST], e[e - s >= LEAST]
    if not len(s):
        return out
    size = e - s
    start = np.append(0, np.cumsum(size)[:-1])
    part = np.repeat(np.arange(len(s)), size)
    src = np.arange(int(size.sum())) + np.repeat(s - start, size)
    both = (row[src].astype(U64) << U64(32)) | x[src].astype(U64)
    _, back, times = np.unique(both, return_inverse=True, return_counts=True)
    hits = hit[src]
    weight = np.where(hits, 1, np.where(times[back] == 1, -round(SIMILARITY / (1 - SIMILARITY)), 0))
    # prefix sums, one more than places for each part, shifted so that each part lies below the one before
    first = start + np.arange(len(s))
    total = np.zeros(len(src) + len(s), dtype=np.int64)
    total[np.arange(len(src)) + part + 1] = weight
    total = np.cumsum(total)
    of = np.repeat(np.arange(len(s)), size + 1)
    total -= total[first][of]
    top, low = np.maximum.reduceat(total, first), np.minimum.reduceat(total, first)
    total += np.append(0, np.cumsum(low[:-1] - top[1:] - 1))[of]
    best, least = np.maximum.accumulate(total[::-1])[::-1], np.minimum.accumulate(total)
    n, place = len(total), np.arange(len(total))
    starts, ends = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    starts[: n - LEAST] = best[LEAST:] >= total[: n - LEAST]
    ends[LEAST:] = least[: n - LEAST] <= total[LEAST:]
    begin = np.maximum.accumulate(np.where(starts, place, -1))
    end = np.minimum.accumulate(np.where(ends, place, n)[::-1])[::-1]
    q = np.arange(len(src)) + part
    ok = (begin[q] >= first[part]) & (end[q + 1] < (first + size + 1)[part])
    out[src[hits & ok]] = True
    return out


def may_hold(x: np.ndarray, others: list) -> np.ndarray:
    """For each of ``others``, the places of x that it shares and that may lie in a similar part: a part of the least length or more
    in which the shared places outweigh the missing ones as _similar_parts has it (missing ones that x repeats weigh nothing)."""
    where, times = first_places(x, others)
    hit = where >= 0
    row, at = np.nonzero(hit)
    out = np.zeros_like(hit)
    out[row, at] = _in_parts(row, at, np.where(times == 1, -round(SIMILARITY / (1 - SIMILARITY)), 0))
    return out


def first_places(x: np.ndarray, others: list) -> tuple[np.ndarray, np.ndarray]:
    """(for each of ``others`` and each place of x, where the other first holds its shingle, or -1; how often x holds it)."""
    v, back, times = np.unique(x, return_inverse=True, return_counts=True)
    size = np.array([len(o) for o in others])
    value, row = np.concatenate(others), np.repeat(np.arange(len(others)), size)
    place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
    at = np.minimum(np.searchsorted(v, value), len(v) - 1)
    ok = np.flatnonzero(v[at] == value)[::-1]
    where = np.full((len(others), len(v)), -1, dtype=np.int32)
    where[row[ok], at[ok]] = place[ok]  # the first one is written last
    return where[:, back], times[back]


def _stretches(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of shared places (row, at) without too large a gap and of the least length."""
    cut = np.flatnonzero((at[1:] - at[:-1] > GAP) | (row[1:] != row[:-1])) + 1
    first, end = np.append(0, cut), np.append(cut, len(at))
    ok = at[end - 1] - at[first] + 1 >= LEAST
    return first[ok], end[ok]


def _in_parts(row: np.ndarray, at: np.ndarray, loss: np.ndarray) -> np.ndarray:
    """Which of the shared places (row, at), in order, may lie in a similar part, where a missing place of x weighs ``loss``."""
    out = np.zeros(len(at), dtype=bool)
    if len(at):
        total = np.append(0, np.cumsum(loss))
        first, end = _stretches(row, at)
        if len(first):
            some = np.arange(int((end - first).sum())) + np.repeat(first - (np.cumsum(end - first) - (end - first)), end - first)
            here = at[some]
            lost = np.append(0, total[here[1:]] - total[np.minimum(here[:-1] + 1, here[1:])])
            out[some] = _inside(np.cumsum(end - first), here, lost)[0]
    return out


def _inside(ends: np.ndarray, at: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of shared places that end before ``ends``, at the places ``at``, each with the weight (0 or less) that is lost
    before it: whether it lies between a start and an end, the least length apart, that outweigh what is lost between; and
    whether it does so together with the next."""
    size = np.diff(np.append(0, ends))
    first = ends - size
    part = np.repeat(np.arange(len(ends)), size)
    lost = lost.copy()
    lost[first] = 0
    a = np.cumsum(lost + 1)
    a -= (a[first] - 1)[part]
    top, low = np.maximum.reduceat(a, first), np.minimum.reduceat(a - 1 - lost, first)
    # each stretch below the one before, so that running extremes need no bounds
    a += np.append(0, np.cumsum(low[:-1] - top[1:] - 1))[part]
    b = a - 1 - lost  # before this place, without what is lost there
    b += lost
    n, place = len(a), np.arange(len(a))
    key = part * (int(at.max()) + LEAST + 1) + at
    best, least = np.maximum.accumulate(a[::-1])[::-1], np.minimum.accumulate(b)
    far = np.searchsorted(key, key + LEAST - 1)  # the first place that makes the least length, in this stretch or the next
    near = np.searchsorted(key, key - LEAST + 1, side="right") - 1
    starts = (far < n) & (best[np.minimum(far, n - 1)] >= b)
    stops = (near >= 0) & (least[near] <= a)
    begin = np.maximum.accumulate(np.where(starts, place, -1))
    stop = np.minimum.accumulate(np.where(stops, place, n)[::-1])[::-1]
    begun, goes_on = begin >= first[part], stop < ends[part]
    on = np.zeros(n, dtype=bool)
    on[:-1] = (part[1:] == part[:-1]) & begun[:-1] & goes_on[1:] & (best[1:] >= least[:-1])
    return begun & goes_on & (best >= least), on


def may_give(x: np.ndarray, others: list, still: np.ndarray, sequence) -> np.ndarray:
    """Which of ``others`` may give x a passage with an open place: by what either text lacks, or all in a row, or the whole stretch.
    ``sequence`` gives the Sequence of one of others by its number."""
    where, times = first_places(x, others)
    weight = -round(SIMILARITY / (1 - SIMILARITY))
    row, at = np.nonzero(where >= 0)
    ok = np.zeros(len(others), dtype=bool)
    ok[row[_in_parts(row, at, np.where(times == 1, weight, 0)) & still[at]]] = True
    some = ok[row]
    row, at = row[some], at[some]
    out = np.zeros(len(others), dtype=bool)
    if not len(at):
        return out
    first, end = _stretches(row, at)
    opened = np.append(0, np.cumsum(still))
    use = opened[at[end - 1] + 1] > opened[at[first]]
    first, end = first[use], end[use]
    if not len(first):
        return out
    size = end - first
    ends = np.cumsum(size)
    some = np.arange(int(ends[-1])) + np.repeat(first - (ends - size), size)
    row, at, begins = row[some], at[some], ends - size
    spot = where[row, at]
    gap, step = at[1:] - at[:-1] - 1, spot[1:] - spot[:-1]
    lost = np.append(0, weight * (gap + np.where((step > 0) & (step <= GAP + 1), step - 1, 0)))
    after = np.append(at[1:], 0)
    after[ends - 1] = at[ends - 1] + 1
    inside, on = _inside(ends, at, lost)
    mine = still[at]
    hit = inside & mine | on & (opened[after] > opened[at + 1])  # the place itself is open, or one before the next
    # in a row
    new = np.append(True, gap != 0)
    new[begins] = True
    heads = np.flatnonzero(new)
    long = np.diff(np.append(heads, len(at))) >= LEAST
    hit |= np.repeat(long, np.diff(np.append(heads, len(at)))) & mine
    out[row[hit]] = True
    # the whole stretch: its different shingles, by where each was before
    rest = np.flatnonzero(~out[row[begins]])
    if len(rest):
        before = _before(x)
        for k in rest.tolist():
            lo, hi = int(begins[k]), int(ends[k])
            s, e = int(at[lo]), int(at[hi - 1])
            kind = before[s : e + 1] < s
            both, own = int(np.count_nonzero(kind[at[lo:hi] - s])), int(np.count_nonzero(kind))
            if both >= SIMILARITY * own - 1e-9:
                low, high = _counterpart(at[lo:hi], spot[lo:hi])
                theirs = int(np.count_nonzero(sequence(int(row[lo])).before[low : high + 1] < low))
                out[row[lo]] |= both / max(own + theirs - both, 1) >= SIMILARITY
    return out


def _everywhere(x: np.ndarray) -> np.ndarray:
    """Spans that cover a sequence of any length."""
    return (np.arange(0, len(x), _CLIP) << 32) | _CLIP


def common_kinds(xs: list, ps: list, free: list) -> tuple[np.ndarray, np.ndarray]:
    """How many different shingles each of xs shares with each of ps, and how many of x's open ones."""

    def places(rows: list) -> tuple[np.ndarray, np.ndarray]:
        value, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.searchsorted(both, value)
        ok = both[np.minimum(at, len(both) - 1)] == value
        return row[ok], at[ok]

    both = np.intersect1d(np.concatenate(xs), np.concatenate(ps))
    shared, fresh = np.zeros((len(xs), len(ps)), dtype=np.float32), np.zeros((len(xs), len(ps)), dtype=np.float32)
    if not len(both):
        return shared, fresh
    (rx, cx), (rp, cp), (rf, cf) = places(xs), places(ps), places([x[f] for x, f in zip(xs, free, strict=True)])
    for lo in range(0, len(both), KINDS):
        held = []
        for n, (r, c) in ((len(xs), (rx, cx)), (len(ps), (rp, cp)), (len(xs), (rf, cf))):
            m = np.zeros((n, min(KINDS, len(both) - lo)), dtype=np.float32)
            k = (c >= lo) & (c < lo + KINDS)
            m[r[k], c[k] - lo] = 1
            held.append(m)
        shared += held[0] @ held[1].T
        fresh += held[2] @ held[1].T
    return shared, fresh


def pair_up(lists: DataFrame) -> DataFrame:
    return lists.filter("doc <> pivot").groupBy("doc", "pivot").agg(F.collect_set("span").alias("x_spans"), F.collect_set("pivot_span").alias("p_spans"))


def repeated_ids(docs: DataFrame) -> DataFrame:
    """(id, text_hash, doc): the texts of ids that occur with several; the first keeps its id as number, others get later ones."""
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"))
    several = texts.groupBy("id").agg(F.min("text_hash").alias("first"), F.max("text_hash").alias("last")).filter("first <> last").select("id", "first")
    each = texts.join(several, "id").distinct()
    return materialise(each.select("id", "text_hash", F.when(F.col("text_hash") == F.col("first"), F.col("id")).otherwise(F.monotonically_increasing_id() + LATER).alias("doc")), "passage-ids")


def repeated_passages(docs: DataFrame, hashes: int = HASHES, rounds: int = ROUNDS) -> DataFrame:
    """A row for every passage that a document shares with one of a smaller id: doc_id, start_word, end_word (exclusive),
    keeper_doc_id, keeper_start, similarity, text_hash (of a repeated id's text, else null). Spans of a document may overlap."""
    numbers = repeated_ids(docs)
    base = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if numbers.isEmpty():
        return _passages(base, hashes, rounds).withColumn("text_hash", F.lit(None).cast("long"))
    own = base.join(numbers, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("text_hash")), "left").select(F.coalesce("doc", "doc_id").alias("doc_id"), "text")
    own = materialise(own, "passage-own")
    found = _passages(own, hashes, rounds)
    discard(own)
    keeper = numbers.select(F.col("doc").alias("k"), F.col("id").alias("kid"))
    found = found.join(numbers, found.doc_id == numbers.doc, "left").join(keeper, found.keeper_doc_id == keeper.k, "left")
    return found.select(F.coalesce("id", "doc_id").alias("doc_id"), "start_word", "end_word", F.coalesce("kid", "keeper_doc_id").alias("keeper_doc_id"), "keeper_start", "similarity", "text_hash")


def _passages(docs: DataFrame, hashes: int, rounds: int) -> DataFrame:
    """The matches of docs(doc_id, text), each id with one text."""
    parts = partitions(docs)
    whole = lists = materialise(scan_lists(windows(docs, hashes), parts), "passage-lists")
    texts, found = one_text(docs), None
    for n in range(rounds):
        pairs = materialise(pair_up(lists), "passage-pairs")
        new = materialise(compare(pairs, texts), "passage-matches")
        found = new if found is None else found.unionByName(new)
        if n + 1 < rounds:
            before, lists = lists, materialise(scan_lists(undone(lists, new).filter("need").select("key", "doc", "span", "tail"), parts), "passage-lists")
            if before is not whole:
                discard(before)
        discard(pairs)
        if lists.isEmpty():
            break
    if lists is not whole:
        discard(lists)
    found = found.unionByName(rest(whole, found, texts, parts))
    discard(whole, texts)
    return found.dropDuplicates(["doc_id", "start_word", "end_word", "keeper_doc_id"])


def one_text(docs: DataFrame) -> DataFrame:
    """docs with each id once: as they are, if none is repeated."""
    several = docs.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if several.isEmpty():
        return docs
    twice = docs.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return materialise(docs.join(several, "doc_id", "left_anti").unionByName(twice), "passage-texts")


def cut(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """docs without the repeated passages, n_chars renewed where a text changed; a document with nothing left goes."""
    spans = matches.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("_spans"))
    given = docs.columns
    names = [n if n in ("doc_id", "text", "n_chars") else f"c{i}" for i, n in enumerate(given)]  # none can clash
    renamed = docs.toDF(*names)
    joined = renamed.join(spans, (renamed.doc_id == spans._id) & (F.col("_hash").isNull() | (F.xxhash64("text") == F.col("_hash"))), "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in renamed.schema.fields)

    def run(it):
        for b in it:
            touched = [i for i, s in enumerate(b.column("_spans").is_valid().to_pylist()) if s]
            if not touched:
                yield b.select(names)
                continue
            text = b.column("text").to_pylist()
            drop = set()
            for i in touched:
                if text[i] is not None:
                    text[i] = without(text[i], b.column("_spans")[i].as_py())
                    if not text[i]:
                        drop.add(i)
            cols = {n: b.column(n) for n in names}
            cols["text"] = pa.array(text, pa.string())
            if "n_chars" in cols:
                old = b.column("n_chars").to_pylist()
                hit = set(touched)
                cols["n_chars"] = pa.array([len(text[i]) if i in hit and text[i] is not None else v for i, v in enumerate(old)], b.column("n_chars").type)
            out = pa.RecordBatch.from_arrays([cols[n] for n in names], names)
            yield out.take(pa.array([i for i in range(len(text)) if i not in drop], pa.int64())) if drop else out

    return joined.select(*names, "_spans").mapInArrow(run, schema).toDF(*given)


def without(text: str, spans: list[dict]) -> str:
    """The text without the given spans of words; what is left around a cut is joined by a line feed."""
    raw, at = string_buffers(pa.array([text]))
    w = Words(raw, at)
    gone = np.zeros(len(w.start) + 1, dtype=np.int64)
    for s in spans:
        gone[min(s["start_word"], len(w.start))] += 1
        gone[min(s["end_word"], len(w.start))] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    if not gone.any():
        return text
    parts, at_byte = [], 0
    starts = np.flatnonzero(gone & ~np.append(False, gone[:-1]))
    ends = np.flatnonzero(gone & ~np.append(gone[1:], False))
    for s, e in zip(starts, ends, strict=True):
        parts.append(raw[at_byte : w.start[s]].tobytes().decode().rstrip())
        at_byte = int(w.end[e])
    parts.append(raw[at_byte:].tobytes().decode().lstrip())
    return "\n".join(p for p in parts if p)
