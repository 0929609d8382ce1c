"""Centroid clustering with annulus search: exact integer k-means whose assignment compares only centroids in reach.

A vector's distance to any centroid is at least the difference of their norms. With the exact distance to the centroid
of nearest norm as an upper bound, only centroids whose norm lies in the annulus [norm - bound, norm + bound] can be as
near; two binary searches in the sorted norms give that range, widened by ``SLACK`` so that rounding of the norms never
excludes a boundary tie. The candidates are then compared by exact integer distances, ties to the smaller number.

Scale: a round is one scan; a task keeps k sums of its vectors and ships them once, k * (dim + 1) rows, which Spark adds
up as decimals. The driver sees the k centroids only. Nothing is shuffled but those sums, so the spread of ids, labels or
repeated vectors doesn't matter, and a lost executor repeats its tasks. Rounds end early when no centroid moves, since
the rest would repeat themselves.

Integers: components are floor(1024 x). Where all of a batch and of the centroids lie within 2^26, distances are 64-bit;
beyond, Python's integers, exact at any size; a distance or sum beyond 64 bits can't be returned and raises.

Nulls, ties and repeats: vectors that are null, not of ``dim`` components, or hold a null or non-finite component are left
out. Repeated rows and ids are vectors of their own; equal hashes start in the order of their components; a null vec_id
hashes as none and starts last. With fewer vectors than k there are as many centroids; without any, an empty result.
There are no texts here; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.io import bound_batches

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
SAFE, SLACK = 1 << 26, 1e-9
ROW = "vec_id {id}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, embedding) of usable vectors; the test stays in the JVM."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.coalesce((F.size("embedding") == dim) & F.forall("embedding", finite), F.lit(False))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(usable)


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit where that holds it, else Python's integers."""
    x = np.floor(values * float(SCALE))
    return x.astype(np.int64) if not x.size or np.abs(x).max() < 2.0**62 else np.array([[int(v) for v in row] for row in x], dtype=object)


def start(rows: DataFrame, k: int, dim: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids: k rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(key.asc_nulls_last(), "embedding").select("embedding").limit(k).collect()
    return scaled(np.array([r.embedding for r in first], dtype=float).reshape(len(first), dim))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, exact squared distance) of each row of integers."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) >= SAFE:
        x, centroids = x.astype(object), centroids.astype(object)
    norms = np.sqrt((centroids.astype(float) ** 2).sum(axis=1))
    order = np.argsort(norms, kind="stable")
    sorted_norms = norms[order]
    own = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    at = np.clip(np.searchsorted(sorted_norms, own), 1, max(len(order) - 1, 1)) if len(order) > 1 else np.zeros(len(x), int)
    if len(order) > 1:
        at = at - (own - sorted_norms[at - 1] <= sorted_norms[at] - own)
    cluster = order[at]
    best = np.empty(len(x), dtype=x.dtype)
    for p in range(len(order)):
        mine = np.flatnonzero(at == p)
        best[mine] = squared(x[mine], centroids[order[p]])
    bound = np.sqrt(best.astype(float))
    slack = SLACK * (1.0 + own + sorted_norms[-1])
    low, high = np.searchsorted(sorted_norms, own - bound - slack), np.searchsorted(sorted_norms, own + bound + slack, side="right")
    for p, c in enumerate(order):
        rows = np.flatnonzero((low <= p) & (p < high) & (at != p))
        d = squared(x[rows], centroids[c])
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        won = rows[better.astype(bool)]
        best[won], cluster[won] = d[better.astype(bool)], c
    return cluster, best


def matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return scaled(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _sums(centroids: np.ndarray, dim: int, with_distance: bool):
    """A task's sums: (cluster, place, total), place -1 for the number of vectors and -2 for their distances."""

    def run(it):
        k = len(centroids)
        totals, counts, far = [[0] * dim for _ in range(k)], [0] * k, [0] * k
        for b in it:
            x = matrix(b, dim)
            cluster, best = nearest(x, centroids)
            for c in np.unique(cluster):
                mine = cluster == c
                counts[c] += int(mine.sum())
                if with_distance:
                    far[c] += sum(best[mine].tolist())
                elif x.dtype == object or np.abs(x[mine]).max(initial=0) >= SAFE:
                    totals[c] = [t + sum(col) for t, col in zip(totals[c], x[mine].T.tolist())]
                else:
                    totals[c] = [t + int(v) for t, v in zip(totals[c], x[mine].sum(axis=0))]
        rows = [(c, p, str(v)) for c in range(k) if counts[c] for p, v in ([(-1, counts[c]), (-2, far[c])] if with_distance else [(-1, counts[c]), *enumerate(totals[c])])]
        if rows:
            cluster, place, total = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()), pa.array(total, pa.string())], ["cluster", "place", "total"])

    return run


def gathered(rows: DataFrame, centroids: np.ndarray, dim: int, with_distance: bool = False) -> dict[tuple[int, int], int]:
    sums = rows.select("embedding").mapInArrow(_sums(centroids, dim, with_distance), "cluster int, place int, total string")
    out = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return {(r.cluster, r.place): int(r.total) for r in out}


def fit_centroids(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """The centroids after the rounds, as integers (floor(sum / count) of each component)."""
    bound_batches(vectors.sparkSession)
    rows = kept(vectors, dim)
    centroids = start(rows, k, dim, seed)
    for _ in range(rounds if len(centroids) else 0):
        total = gathered(rows, centroids, dim)
        moved = [[total[c, p] // total[c, -1] for p in range(dim)] if (c, -1) in total else [int(v) for v in centroids[c]] for c in range(len(centroids))]
        wide = any(abs(v) >= 1 << 62 for row in moved for v in row)
        moved = np.array(moved, dtype=object if wide else np.int64)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, dim: int = DIM) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], ROW.format(id=kind))
    rows = kept(vectors, dim)
    total = gathered(rows, centroids, dim, with_distance=True)
    inertia = [total.get((c, -2), 0) for c in range(len(centroids))]
    every, digest = sum(inertia), [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]

    def run(it):
        for b in it:
            cluster, best = nearest(matrix(b, dim), centroids)
            take = cluster.tolist()
            cols = [b.column("vec_id"), pa.array(take, pa.int32()), pa.array(best.tolist(), pa.int64()), pa.array([inertia[c] for c in take], pa.int64()), pa.array([every] * len(take), pa.int64()), pa.array([digest[c] for c in take], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(run, ROW.format(id=kind))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    return assign(vectors, fit_centroids(vectors, k, rounds, dim, seed), dim)
