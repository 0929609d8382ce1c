"""Near copies by word sets against all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from claimforge.operators import near as N, search as S


def made(rng):
    """Short and long sets, near copies of them, and chance meetings in common words."""
    words = [f"w{i}" for i in range(3000)]
    out = [rng.sample(words[:60], rng.randrange(1, 12)) for _ in range(60)] + [rng.sample(words, rng.choice([40, 700, 1500])) for _ in range(50)]
    for s in list(out):
        lost = rng.randrange(0, max(1, len(s) // 4))
        out.append(s[lost:] + [f"x{i}" for i in range(rng.randrange(0, 1 + len(s) // 12))])
    return [(i, i % 2, sorted(set(s))) for i, s in enumerate(out)]


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_near_pairs_equal_all_pairs(spark, threshold):
    sets = made(random.Random(3))
    want = {(a, b) for (a, x, s), (b, y, t) in combinations(sets, 2) if x == y and 100 * len(set(s) & set(t)) >= round(100 * threshold) * len(set(s) | set(t))}
    got = [(r.a, r.b) for r in N.near_pairs(spark.createDataFrame(sets, "id long, scope int, s array<string>"), threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_long_sets_that_meet_by_chance_are_not_compared(spark):
    rng = random.Random(1)
    rows = [(i, 0, sorted(rng.sample([f"w{k}" for k in range(4000)], 1500))) for i in range(60)]
    sets = spark.createDataFrame(rows, "id long, scope int, s array<string>")
    h = N.heads(sets, 0.85, N.bucket_counts(sets))
    assert N.candidates(h.alias("a"), h.alias("b"), 0.85, F.col("a.id") < F.col("b.id")).count() == 0  # all 1770 pairs meet


def test_copies_go_to_the_least_id_and_are_not_paired(spark):
    base = " ".join(f"word{i}" for i in range(30))
    rows = [(i, base if i % 3 else base + " more", "en") for i in range(3000)] + [(9000, base, "de"), (9001, "", "en"), (9002, base, None), (9003, None, "en")]
    got = {r.id: (r.of, r.jaccard) for r in S.jaccard_duplicates(spark.createDataFrame(rows, "id long, text string, scope string"), 0.85, 50).collect()}
    assert len(got) == 2999 and got[1] == (0, round(30 / 31, 6)) and got[2] == (1, 1.0) and got[3] == (0, 1.0)
