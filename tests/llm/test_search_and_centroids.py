"""Ranked lexical search and centroid clustering against plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimforge.llm import centroids as C
from claimforge.llm import lexical as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, term string, score long"


def terms(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    lists = [(d, terms(t)) for d, t in docs]
    lists = [(d, w) for d, w in lists if w]
    n_docs, n_words = len(lists), sum(len(w) for _, w in lists)
    counts = [(d, Counter(w), len(w)) for d, w in lists]
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        scores = []
        for d, c, n in counts:
            m = 10 + (90 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, math.inf if d is None else d))
        out += [(i, r + 1, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.fixture(scope="module")
def items(spark, corpus):
    rows = [(1, corpus[0][1], "x", 1), (1, "extra Wh WORDS é", "x", 1), (2, corpus[4][1], "x", 1), (3, None, "x", 1), (4, " !? ", "x", 1), (5, "nothing-known zzz", "x", 1), (None, "changed the", "x", 1), (6, "vile", "x", 1), (6, "vile", "x", 1)]
    return rows, spark.createDataFrame(rows, ITEMS)


def test_ranked_search_equals_brute_force(docs, corpus, items):
    rows, frame = items
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in L.search(docs, frame).collect())
    assert got == ranked([(r[0], r[1]) for r in corpus], [(r[0], r[1]) for r in rows])


def test_ranked_search_in_blocks_and_in_other_partitions_is_the_same(docs, corpus, items):
    rows, frame = items
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in L.search(docs.repartition(7), frame, k=3, block_terms=10).collect())
    assert got == ranked([(r[0], r[1]) for r in corpus], [(r[0], r[1]) for r in rows], 3)


def test_ranked_search_of_empty_tables(spark, docs, empty, items):
    assert L.search(empty, items[1]).count() == 0
    assert L.search(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_ranked_search_reads_a_very_long_text_and_any_character(spark):
    long = "Straße \U0001f600a É é 7 " * 100_000
    rows = [(1, long), (2, "straße"), (3, "É"), (3, "É"), (4, "é x"), (5, None)]
    asked = [(1, "STRAßE é", "", 0), (2, "\U0001f600A", "", 0), (3, "x É", "", 0)]
    got = Counter(tuple(r) for r in L.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, ITEMS)).select("item_id", "rank", "doc_id", "score").collect())
    assert got == ranked(rows, [a[:2] for a in asked])


VECTORS = "vec_id long, embedding array<float>, cluster string, distance string"


def plain_kmeans(rows, dim, k, rounds, seed=3):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    final = [(i, *near(v)[::-1]) for i, v in kept]
    by = Counter()
    for _, c, d in final:
        by[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, c, d, by[c], sum(by.values()), names[c]) for i, c, d in final)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b") for i, v in rows], VECTORS).repartition(3)


def found(df):
    return Counter(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect())


@pytest.mark.parametrize("scale", [1.0, 0.002, 3000.0, 1.0e5])
def test_centroids_equal_plain_kmeans(spark, scale):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in (rng.normal(size=5) + (i % 3)) * scale]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(3, rows[3][1]), (None, rows[5][1]), (None, rows[6][1])]
    rows += [(300, None), (301, [1.0] * 4), (302, [1.0] * 6), (303, [1.0, None, 1.0, 1.0, 1.0]), (304, [float("nan")] * 5), (305, [1.0, 1.0, float("-inf"), 1.0, 1.0]), (306, [])]
    assert found(C.cluster(frame(spark, rows), k=4, dim=5)) == plain_kmeans(rows, 5, 4, 10)


def test_ties_between_centroids_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), float(i // 2 % 2)]) for i in range(16)] + [(50, [0.5, 0.5])]
    assert found(C.cluster(frame(spark, rows), k=4, dim=2, rounds=0)) == plain_kmeans(rows, 2, 4, 0)
    x, c = np.array([[0, 0], [5, 0]]), np.array([[3, 0], [0, 3], [-3, 0], [0, -3], [7, 0]])
    assert [v.tolist() for v in C.nearest(x, c)] == [[0, 0], [9, 4]]


def test_few_vectors_and_none(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0])]
    assert found(C.cluster(frame(spark, rows), dim=2)) == plain_kmeans(rows, 2, 8, 10)
    assert C.cluster(frame(spark, rows).filter(F.lit(False)), dim=2).count() == 0


def test_components_beyond_64_bit_squares_stay_exact():
    x, c = np.array([[1 << 40, 5]]), np.array([[(1 << 40) + 1, 5], [(1 << 40) - 1, 5], [0, 0]])
    cluster, best = C.nearest(x, c)
    assert cluster.tolist() == [0] and best.tolist() == [1]
