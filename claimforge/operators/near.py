"""Near copies by word sets, exactly: prefixes of rare words, parity maps, then the sets themselves.

A set of n words offers the floor((1 - t) n) + 1 first ones of a fixed order of all words; two sets with a Jaccard of t or
more share one of those. The order goes by how often the words of a hash bucket occur, so it needs no join: BUCKETS counts
reach every task. It changes cost only. A parity map says of each of 256 hash places whether the set has an odd number of words
there; maps differ in no more places than sets differ in words. What two prefixes share, and all that can follow behind one of
them, bounds what the sets share. Both settle nearly all pairs that meet in a word by chance: small sets the map, large ones the count.
Words hold no blank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from claimforge.streaming.streams import stored

BUCKETS, MAPS, EPS = 1 << 17, 4, 1e-9


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """How many words of all sets fall into each bucket: BUCKETS numbers, whatever the input."""
    rows = sets.select(F.explode("s").alias("t")).groupBy(F.xxhash64("t").bitwiseAND(BUCKETS - 1).cast("int").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for x in rows.toArrow().to_batches():
        out[x.column("at").to_numpy()] = x.column("n").to_numpy()
    return out


def parity_maps(words: Column) -> list[Column]:
    """MAPS longs; a word flips one bit of them."""
    at = F.transform(words, lambda t: F.pmod(F.xxhash64(t, F.lit(1)), F.lit(64 * MAPS)))
    one = lambda i: F.aggregate(at, F.lit(0).cast("long"), lambda acc, p: F.when(F.floor(p / 64) == i, acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int")))).otherwise(acc))
    return [one(i).alias(f"m{i}") for i in range(MAPS)]


def heads(sets: DataFrame, threshold: float, counts: np.ndarray) -> DataFrame:
    """sets(id, scope, s), s sorted -> (id, scope, n, p, m0.., h): a row for each hashed word of a set's prefix of p.

    Words of equal hash go by their place in the sorted set, so the order is one of words; equal hashes of other words
    only let more pairs meet.
    """
    known = sets.sparkSession.sparkContext.broadcast(counts)

    def first(h: pd.Series, k: pd.Series) -> pd.Series:
        if not len(h):
            return pd.Series([], dtype=object)
        sizes = np.array([len(x) for x in h])
        flat, row = np.concatenate(list(h)), np.repeat(np.arange(len(h)), sizes)
        flat = flat[np.lexsort((flat, known.value[flat & (BUCKETS - 1)], row))]
        ends = np.cumsum(sizes)
        return pd.Series([flat[e - n : e - n + m].tolist() for e, n, m in zip(ends, sizes, k, strict=True)])

    x = sets.select("id", "scope", F.size("s").alias("n"), F.transform("s", lambda t: F.xxhash64(t)).alias("h"), *parity_maps(F.col("s")))
    k = F.floor((1 - threshold) * F.col("n") + EPS).cast("int") + 1
    return x.select("id", "scope", "n", k.alias("p"), *[f"m{i}" for i in range(MAPS)], F.explode(F.pandas_udf(first, "array<long>")("h", k)).alias("h"))


def close(a: str, b: str, threshold: float) -> Column:
    """Whether two heads' sets can reach the threshold: sizes near enough, maps that differ in few enough places."""
    col = lambda s, c: F.col(f"{s}.{c}")
    n, m = col(a, "n"), col(b, "n")
    apart = sum(F.bit_count(col(a, f"m{i}").bitwiseXOR(col(b, f"m{i}"))) for i in range(MAPS))
    return (F.least(n, m) >= threshold * F.greatest(n, m) - EPS) & (apart <= (1 - threshold) / (1 + threshold) * (n + m) + 1e-6)


def enough(threshold: float) -> Column:
    """Of met(n, m, p, q, c): c words shared by both prefixes. Of the prefix that ends first, all shared words count; behind it
    the rest of that set at most is shared."""
    return F.col("c") + F.greatest(F.col("n") - F.col("p"), F.col("m") - F.col("q")) >= threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-6


def candidates(left: DataFrame, right: DataFrame, threshold: float, meet: Column) -> DataFrame:
    """Heads aliased a and b -> (a, b): pairs that meet and can reach the threshold."""
    x = left.join(right, (F.col("a.h") == F.col("b.h")) & meet & close("a", "b", threshold))
    x = x.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("n"), F.col("b.n").alias("m"), F.col("a.p").alias("p"), F.col("b.p").alias("q")).agg(F.count(F.lit(1)).alias("c"))
    return stored(x.filter(enough(threshold)).select("a", "b"), "near-candidates")


def near_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """sets(id, scope, s), s distinct and not empty -> (a, b, shared, n, m), a < b: sets of the same scope with a Jaccard of ``threshold`` or more."""
    sets = stored(sets.select("id", "scope", F.array_sort("s").alias("s")), "near-sets")
    h = stored(heads(sets, threshold, bucket_counts(sets)), "near-heads")
    pairs = candidates(h.alias("a"), h.alias("b"), threshold, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.id") < F.col("b.id")))
    return verified(pairs, sets, sets, threshold)


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs(a, b) whose sets really reach the threshold, with the sizes of both and of what they share. Only sets of
    a pair are shuffled, each as one text."""
    one = left.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.array_join("s", " ").alias("s1"))
    two = right.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("b"), F.array_join("s", " ").alias("s2"))
    s1, s2 = F.split("s1", " "), F.split("s2", " ")
    x = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect(s1, s2)).alias("shared"), F.size(s1).alias("n"), F.size(s2).alias("m"))
    return x.filter(F.col("shared") >= threshold * (F.col("n") + F.col("m") - F.col("shared")) - EPS)
