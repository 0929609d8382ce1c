"""Exact Jaccard self-join on 5-word shingle sets: a size-aware heavy-light join, then connected components.

1. Equal sets become one class with a number of its own; only classes are joined.
2. Small sets (size <= boundary) enumerate their subsets of the size that a link of the two sizes must share: equal
   subsets are links. Large sets scan inverted lists: two sets within the threshold share one of the first
   n - ceil(0.8 n) + 1 shingles under any fixed order. The order puts shingles that many documents hold last, so a
   passage that thousands of documents share makes no list unless a text is nearly all passage. The boundary is the
   one of least cost: subsets emitted against list postings, over the measured sizes (beyond ``SMALL_MOST`` one set
   would enumerate thousands of subsets against a handful of postings, so no larger boundary can be cheapest).
3. Within a list every set is paired with one pivot, the set with the fewest rare shingles (nearest to what the list
   has in common), never all with all. Pairs are tested by size, by an upper bound of the overlap from parity maps of
   about a bit a shingle, then exactly on the texts. Sets that now share a component need no further test; the pairs of
   a list across components, which only the pivot had joined, are tested in a second pass, in blocks of a list.

Exact: every pair within the threshold shares a list, and is tested or already connected. The document frequencies are
a bounded hint for the order (at most ``HINTS`` shingles), never a filter.

Scale: shingles are hashed in numpy; one shuffle of list postings (a fifth of the shingles, 8 byte keys), small ones
of candidates. Lists are scanned as sorted streams; those of the ``HOT`` commonest shingles are dealt over ``SALTS``
tasks and get their pivot from a table of at most ``HOT`` rows. Only texts of candidates are shuffled for the exact
test: a bitmap of ``ID_BITS`` bits over hashed ids, of the same size for every input, keeps most others back (the join
behind it is exact). Partition counts grow with the bytes that are shuffled.

Nulls: null, empty and blank texts have no shingles and are linked with nothing; fewer than five words make one shingle
of the whole sequence; repeated rows are linked as copies, and rows that repeat an id with another text are linked by
their own text; rows with a null doc_id belong to the class of their text but never name it; ties between pivots go to
the smaller class number and change no link; very long texts make long maps (an eighth of a byte to a quarter a
shingle) and nothing else; empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.components import components
from claimforge.llm.io import among, discard, materialise, partitions
from claimforge.llm.kernel import Words, chunks, distinct, mix, shingles

PERCENT = 80
SMALL_MOST = 24  # sets up to this size keep all their shingles; the boundary is at most this
FLUSH = 3_000_000
HEAVY, HINTS = 12, 1 << 20
HOT, HOT_LEAST, SALTS = 1024, 500, 32
LIST_COST = 3.0  # cost of a posting in a scanned list, in emitted subset keys
LEAST_BITS = 256
PAIRS, MAP_BYTES = 1 << 18, 16 << 20  # compared at a time
BLOCK = 2048  # members of a list that are compared with each other, or with as many others, in one group
U64 = np.uint64


def need(a: int, b: int) -> int:
    """Least overlap of linked sets of these sizes."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (PERCENT * n + 99) // 100 + 1


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending: (values, bounds)."""
    value, doc, _ = shingles(Words(raw, at))
    return distinct(value, doc, len(at) - 1)


def signature(v: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        run = np.zeros(len(v) + 1, dtype=U64)
        np.cumsum(mix(v ^ U64(salt)), out=run[1:])
        out.append((run[bounds[1:]] - run[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def parity_maps(v: np.ndarray, n: np.ndarray) -> pa.Array:
    """A map for each set: the parity of its shingles in 2^k >= n places (at least LEAST_BITS), packed."""
    size = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    start = np.cumsum(size) - size
    place = np.repeat(start, n) + ((v >> U64(17)).astype(np.int64) & np.repeat(size - 1, n))
    packed = np.packbits((np.bincount(place, minlength=int(size.sum())) & 1).astype(np.uint8))
    offsets = np.append(0, np.cumsum(size // 8)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])


def rows_of(maps: pa.Array, rows: np.ndarray, width: int, to: int) -> np.ndarray:
    """The maps of ``rows``, all ``width`` bytes long, folded to ``to`` bytes: a map of half the places is the halves' xor."""
    taken = maps.take(pa.array(rows))
    start = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset]
    x = np.frombuffer(taken.buffers()[2], np.uint8)[start : start + len(rows) * width].reshape(len(rows), width)
    while width > to:
        width //= 2
        x = x[:, :width] ^ x[:, width:]
    return np.ascontiguousarray(x).view(np.uint64)


def widths(maps: pa.Array) -> np.ndarray:
    return pc.binary_length(maps).to_numpy(zero_copy_only=False).astype(np.int64)


def may_reach(total: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Whether sets of ``total`` shingles together whose maps differ in so many places can be linked: overlap <= (total - differ) / 2."""
    return (total - differ) // 2 * (100 + PERCENT) >= PERCENT * total


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A hint: shingles that often recur within a few million of a task's, summed over tasks; sorted, at most HINTS. And the HOT commonest."""

    def run(it):
        held, size = [], 0

        def flush():
            v, c = np.unique(np.concatenate(held), return_counts=True)
            v, c = v[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c)], ["key", "n"])

        for b in it:
            for _, _, raw, at in chunks(b.column("text")):
                v, _ = shingle_sets(raw, at)
                held.append(v)
                size += len(v)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counts = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY)
    top = counts.orderBy(F.desc("n"), "key").limit(HINTS).toArrow()
    key, n = top.column("key").to_numpy().astype(np.int64).view(U64), top.column("n").to_numpy()
    hottest = np.lexsort((key, -n))[:HOT]
    return np.sort(key), np.sort(key[hottest][n[hottest] >= HOT_LEAST])


def profile(docs: DataFrame, hint: np.ndarray) -> DataFrame:
    """Per row: doc_id, text_hash, n, sig_a, sig_b, rare (rare shingles in the prefix), tokens (prefix, or all of a small set), bits."""
    shared = docs.sparkSession.sparkContext.broadcast(hint)

    def run(it):
        hint = shared.value
        for b in it:
            for lo, hi, raw, at in chunks(b.column("text")):
                v, bounds = shingle_sets(raw, at)
                n = np.diff(bounds)
                a, c = signature(v, bounds)
                doc = np.repeat(np.arange(hi - lo), n)
                if len(hint):
                    place = np.minimum(np.searchsorted(hint, v), len(hint) - 1)
                    heavy = hint[place] == v
                else:
                    heavy = np.zeros(len(v), dtype=bool)
                order = np.lexsort((v, heavy, doc))
                take = np.where(n <= SMALL_MOST, n, prefix_size(n))
                first = np.arange(len(v)) - np.repeat(bounds[:-1], n) < np.repeat(take, n)
                chosen = order[first]
                offsets = np.zeros(hi - lo + 1, dtype=np.int32)
                np.cumsum(take, out=offsets[1:])
                rare = np.bincount(doc[chosen][~heavy[chosen]], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("text_hash").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a), pa.array(c), pa.array(rare, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[chosen].view(np.int64))), parity_maps(v, n)],
                    ["doc_id", "text_hash", "n", "sig_a", "sig_b", "rare", "tokens", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n long, sig_a long, sig_b long, rare int, tokens array<long>, bits binary")


def boundary(sizes: dict[int, int]) -> int:
    """The largest size that enumerates subsets: least total of subset keys and list postings over the small sizes."""

    def cost(x: int) -> float:
        total = 0.0
        for n, h in sizes.items():
            total += h * sum(comb(n, need(n, b)) for b in partners(n) if b <= x) if n <= x else 0
            if n * 100 > x * PERCENT or n > x:
                total += h * LIST_COST * float(prefix_size(np.array(n)))
        return total

    return min(range(3, SMALL_MOST + 1), key=lambda x: (cost(x), x))


def partners(n: int) -> list[int]:
    """Sizes that a linked set may have, where more than an equal set is possible."""
    return [b for b in range(1, 2 * n + 2) if 100 * min(n, b) >= PERCENT * max(n, b) and need(n, b) <= min(n, b) and need(n, b) < max(n, b)]


def postings(classes: DataFrame, x: int, hot: np.ndarray) -> DataFrame:
    """(key, salt, doc, n, rare): subset keys of small sets, prefix keys of those that may meet a large one. Hot keys have a salt, others 0."""
    shared = classes.sparkSession.sparkContext.broadcast(hot)

    def run(it):
        hot = shared.value
        for b in it:
            n = b.column("n").to_numpy()
            lists = b.column("tokens")
            flat, off = lists.values.to_numpy().view(U64), lists.offsets.to_numpy().astype(np.int64)
            size = np.where(n * 100 > x * PERCENT, np.minimum(prefix_size(n), np.diff(off)), 0)
            # tokens of a small set hold rare ones first too, so its prefix is their head
            start = off[:-1]
            total = np.cumsum(size)
            at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - size), size)
            keys, row = [flat[at]], [np.repeat(np.arange(len(n)), size)]
            extra_k, extra_r = [], []
            for i in np.flatnonzero((n <= x) & (n >= 4)):
                tokens = np.sort(flat[off[i] : off[i + 1]])
                for p in partners(int(n[i])):
                    if p <= x:
                        c, salt = need(int(n[i]), p), U64(min(int(n[i]), p) * 64 + max(int(n[i]), p) + 1)
                        for pick in combinations(tokens.tolist(), c):
                            h = mix(np.array(pick, dtype=U64) ^ salt).sum(dtype=U64)
                            extra_k.append(int(mix(np.array([h]))[0]))
                            extra_r.append(i)
            if extra_k:
                keys.append(np.array(extra_k, dtype=U64))
                row.append(np.array(extra_r))
            key, row = np.concatenate(keys), np.concatenate(row)
            doc = b.column("doc").to_numpy()[row]
            salt = np.zeros(len(key), dtype=np.int16)
            if len(hot):
                common = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                salt[common] = 1 + (mix(doc[common].view(U64)) % U64(SALTS)).astype(np.int16)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt), pa.array(doc), pa.array(n[row], pa.int32()), b.column("rare").take(pa.array(row))], ["key", "salt", "doc", "n", "rare"])

    return classes.select("doc", "n", "rare", "tokens").mapInArrow(run, "key long, salt short, doc long, n int, rare int")


def scan_lists(post: DataFrame, parts: int) -> DataFrame:
    """Lists of two sets or more, with the pivot of each: (key, salt, doc, n, rare, pivot, pivot_n). A streaming scan of sorted
    partitions; the parts of a hot key keep their single rows, and each has a pivot of its own."""
    schema = "key long, salt short, doc long, n int, rare int, pivot long, pivot_n int"

    def run(it):
        last = None  # (key, salt, doc, n, rare, pivot, pivot_n, emitted) of the row that ended the batch before: it may begin a list
        for b in it:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in ("key", "salt", "doc", "n", "rare")]
            if last is not None:
                cols = [np.append(np.array([x], dtype=y.dtype), y) for x, y in zip(last[:5], cols, strict=True)]
            key, salt, doc, n, _ = cols
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            pivot, pivot_n = doc[lead], n[lead]
            keep = ~(new & np.append(new[1:], True)) | (salt > 0)
            if last is not None:
                pivot, pivot_n = np.where(lead == 0, last[5], pivot), np.where(lead == 0, last[6], pivot_n)
                keep[0] &= not last[7]
            last = (*(c[-1] for c in cols), pivot[-1], pivot_n[-1], bool(not new[-1] or salt[-1] > 0))
            if keep.any():
                yield pa.RecordBatch.from_arrays([*[pa.array(c[keep]) for c in cols], pa.array(pivot[keep]), pa.array(pivot_n[keep].astype(np.int32))], [c.split()[0] for c in schema.split(", ")])

    return post.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "rare", "doc").mapInArrow(run, schema)


def one_pivot(lists: DataFrame) -> DataFrame:
    """The lists with one pivot for all parts of a hot key, from a table of at most HOT rows."""
    first = lists.filter("salt > 0").groupBy("key").agg(F.min(F.struct("rare", "doc", "n")).alias("p")).select(F.col("key").alias("k"), "p")
    joined = lists.join(F.broadcast(first), F.col("key") == F.col("k"), "left")
    return joined.select("key", "doc", "n", F.coalesce("p.doc", "pivot").alias("pivot"), F.coalesce("p.n", "pivot_n").alias("pivot_n"))


def mixed_lists(lists: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """Members, but for pivots, of lists that hold several components, in blocks: (key, lo, hi, block, doc, n, comp, bits).

    A list of more than BLOCK members is split; a member goes to each pair of its block with another, so that no group
    holds more than two blocks however long the list is.
    """
    rows = lists.filter("doc <> pivot").join(comp, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("comp"))
    keys = rows.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("size")).filter("least <> most")
    keys = keys.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    rows = rows.join(keys, "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "n", "comp")
    return rows.join(classes.select("doc", "bits"), "doc")


def across(members: DataFrame, parts: int) -> DataFrame:
    """(a, b): pairs of a list in different components that sizes and parity maps let pass.

    Sizes and maps are compared where the block lies, PAIRS at a time, so that only pairs which need the exact test leave
    the task.
    """
    names = ("key", "lo", "hi", "block", "doc", "n", "comp")

    def groups(cols):
        """The number of each row's group: rows of one come together."""
        new = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)
        return np.append(0, np.cumsum(new)) if len(cols[0]) else np.zeros(0, dtype=np.int64)

    def passing(cols, maps):
        group = groups(cols)
        order = np.lexsort((cols[5], group))
        group, maps = group[order], maps.take(pa.array(order))
        _, lo, hi, block, doc, n, comp = (c[order] for c in cols)
        total, split, width = n.astype(np.int64), lo != hi, widths(maps)
        place, table = np.zeros(len(n), dtype=np.int64), {}
        for w in np.unique(width).tolist():
            k = np.flatnonzero(width == w)
            place[k], table[w] = np.arange(len(k)), rows_of(maps, k, w, w)
            if 2 * w <= width.max():
                table[w, "folded"] = rows_of(maps, np.flatnonzero(width == 2 * w), 2 * w, w)
        far = int(total.max()) * 2 + 2
        end = np.searchsorted(group * far + total, group * far + np.minimum(100 * total // PERCENT, far - 1), side="right")
        count = end - np.arange(len(n)) - 1  # later ones of the group whose size allows a link
        upto, i0 = np.cumsum(count), 0
        while i0 < len(n):
            i1 = max(i0 + 1, int(np.searchsorted(upto, upto[i0] - count[i0] + PAIRS, side="right")))
            i = np.repeat(np.arange(i0, i1), count[i0:i1])
            j = np.arange(len(i)) - np.repeat(upto[i0:i1] - count[i0:i1] - (upto[i0] - count[i0]), count[i0:i1]) + i + 1
            ok = (comp[i] != comp[j]) & ~(split[i] & (block[i] == block[j]))
            i, j = i[ok], j[ok]
            for w in np.unique(width[i]).tolist():
                for other, to in ((w, table[w]), (2 * w, table.get((w, "folded")))):
                    k = np.flatnonzero((width[i] == w) & (width[j] == other))
                    for s in range(0, len(k), max(1, MAP_BYTES // w)):
                        p, q = i[k[s : s + max(1, MAP_BYTES // w)]], j[k[s : s + max(1, MAP_BYTES // w)]]
                        differ = np.zeros(len(p), dtype=np.int64)
                        for word in np.bitwise_count(table[w][place[p]] ^ to[place[q]]).T:
                            differ += word
                        found = may_reach(total[p] + total[q], differ)
                        if found.any():
                            p, q = doc[p[found]], doc[q[found]]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])
            i0 = i1

    def run(it):
        cols, maps = None, None  # rows of the group that is being read
        for b in it:
            if not b.num_rows:
                continue
            own = [b.column(c).to_numpy() for c in names]
            cols, maps = (own, b.column("bits")) if cols is None else ([np.concatenate(c) for c in zip(cols, own, strict=True)], pa.concat_arrays([maps, b.column("bits")]))
            group = groups(cols)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield from passing([c[:whole] for c in cols], maps.slice(0, whole))
                cols, maps = [c[whole:] for c in cols], maps.slice(whole)
        if cols is not None:
            yield from passing(cols, maps)

    return members.select(*names, "bits").repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long")


def may_link(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs(a, b) whose overlap may suffice by sizes and parity maps."""
    side = classes.select("doc", "n", "bits")
    left = side.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = side.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))

    def run(it):
        for t in it:
            if not t.num_rows:
                continue
            x, y = t.column("bits_a"), t.column("bits_b")
            wx, wy = widths(x), widths(y)
            differ = np.zeros(t.num_rows, dtype=np.int64)
            for p, q in set(zip(wx.tolist(), wy.tolist(), strict=True)):
                k = np.flatnonzero((wx == p) & (wy == q))
                differ[k] = np.bitwise_count(rows_of(x, k, p, min(p, q)) ^ rows_of(y, k, q, min(p, q))).sum(axis=1, dtype=np.int64)
            total = t.column("n_a").to_numpy() + t.column("n_b").to_numpy()
            yield t.select(["a", "b"]).filter(pa.array(may_reach(total, differ)))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The linked ones of pairs(a, b), by the exact overlap of the sets of the classes' texts."""
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(classes.select("doc", "rep", "text_hash"), "doc"), "jaccard-wanted")
    texts = among(docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), "text"), wanted, "rep")
    texts = materialise(texts.dropDuplicates(["rep", "text_hash"]).join(wanted, ["rep", "text_hash"]).select("doc", "text"), "jaccard-texts")

    def sets_of(column):
        """(number of each row's set, sets): equal neighbours have one."""
        new = np.ones(len(column), dtype=bool)
        new[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
        sets = []
        for _, _, raw, at in chunks(column.take(pa.array(np.flatnonzero(new)))):
            v, bounds = shingle_sets(raw, at)
            sets += [v[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return np.cumsum(new) - 1, sets

    def linked(it):
        for t in it:
            if not t.num_rows:
                continue
            (ga, xs), (gb, ys) = sets_of(t.column("text_a")), sets_of(t.column("text_b"))
            ok = []
            for i in range(t.num_rows):
                x, y = xs[ga[i]], ys[gb[i]]
                inter = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                if 100 * inter >= PERCENT * (len(x) + len(y) - inter):
                    ok.append(i)
            yield t.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    x = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    out = materialise(x.select("a", "b", "text_a", "text_b").mapInArrow(linked, "a long, b long"), "jaccard-links")
    discard(wanted, texts)
    return out


def near_duplicates(docs: DataFrame, keep_hash: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included); with
    ``keep_hash`` also text_hash (xxhash64 of the text), which tells rows of a repeated id apart."""
    hint, hot = common_shingles(docs)
    rows = materialise(profile(docs, hint), "jaccard-rows")
    ids = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "sig_a", "sig_b").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    # numbered as written: a class has one number whatever is read again
    own = materialise(ids.select("n", "sig_a", "sig_b", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("text_hash"), F.monotonically_increasing_id().alias("doc")), "jaccard-classes")
    number = own.select(F.col("rep").alias("doc_id"), "text_hash", "sig_a", "sig_b", "doc", "rep")
    one = rows.filter("n > 0").join(number, ["doc_id", "text_hash", "sig_a", "sig_b"]).select("doc", "rep", "text_hash", "n", "rare", "tokens", "bits")
    classes = materialise(one, "jaccard-sets")  # repeated rows of a class's first document repeat its postings, which pairs of different classes never see
    narrow = materialise(rows.select("doc_id", "text_hash", "n", "sig_a", "sig_b"), "jaccard-narrow")
    discard(rows)
    parts = partitions(classes)
    sizes = {r.n: r["count"] for r in own.filter(F.col("n") <= 2 * SMALL_MOST).groupBy("n").count().collect()}
    found = materialise(scan_lists(postings(classes, boundary(sizes), hot), parts), "jaccard-lists")
    lists = one_pivot(found)
    star = lists.filter(f"doc <> pivot AND 100 * least(n, pivot_n) >= {PERCENT} * greatest(n, pivot_n)").select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()
    pairs = materialise(may_link(star, classes), "jaccard-pairs")
    first = verify(pairs, classes, docs)
    comp = components(first)
    rest = materialise(across(mixed_lists(lists, comp, classes), parts).distinct(), "jaccard-rest")
    discard(pairs, found)
    if not rest.isEmpty():
        second = verify(rest, classes, docs)
        if not second.isEmpty():
            before, comp = comp, components(first.unionByName(second))
            discard(before)
        discard(second)
    discard(first, rest, classes)
    joined = own.join(comp, own.doc == comp.node, "left").withColumn("component", F.coalesce("component", "doc"))
    named = joined.join(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("n", "sig_a", "sig_b", "component_id")
    out = narrow.join(named, ["n", "sig_a", "sig_b"], "left")
    given = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")]
    return out.select(*given, *(["text_hash"] if keep_hash else []))
