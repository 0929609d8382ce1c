"""Work in progress takes no more disk than its tables: rounds and shuffles are dropped, rows are not listed pair by pair."""

import os

from pyspark.sql import functions as F

from claimforge.operators import graph as X, observations as O


def held(spark):
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)


def test_rounds_of_components_do_not_stay_on_disk(spark):
    edges = spark.range(30000).select(F.concat(F.lit("n"), F.col("id")).alias("src"), F.concat(F.lit("n"), F.floor(F.col("id") / 3)).alias("dst"))
    before = held(spark)
    assert X.components(edges).filter("component <> 'n0'").count() == 0
    assert held(spark) - before < 2_000_000


def test_totals_are_those_of_the_members(spark):
    rows = [("a", c, e, g) for c, e, g in ((1, 1, "x"), (2, 2, "x"), (2, 2, "y"), (3, 1, "y"), (2, 1, "y"), (7, 9, None), (8, 10, None))] + [("b", i, i, "h") for i in range(1, 22)] + [(None, 1, 1, "x")]
    s = spark.createDataFrame(rows, "scope string, claim_id long, evidence long, signature string")
    x = O.discover(s).groupBy("scope", "code").agg(F.countDistinct("component").alias("components"), F.countDistinct("claim_id").alias("claims"), F.countDistinct("evidence").alias("evidence"))
    want = {("a", "eligible"): (1, 3, 2), ("a", "below_eligibility_threshold"): (2, 0, 2), ("b", "below_eligibility_threshold"): (21, 0, 21)}  # no signature: nothing tied, nothing supported
    assert {(r.scope, r.code): (r.components, r.claims, r.evidence) for r in x.collect()} == want
    got = O.totals(s).collect()
    assert {(r.scope, r.code): (r.components, r.claims, r.evidence) for r in got} == want
    assert {r.scope: r.hubs for r in got} == {"a": 0, "b": 1}
    assert sorted((r["group"], r.claim_id) for r in O.groups(s, "eligible").collect()) == [("a|e|1", 1), ("a|e|1", 2), ("a|e|1", 3)]


def test_suggestions_equal_all_pairs_without_listing_them(spark):
    import random
    from collections import Counter

    rng = random.Random(4)
    links = {(c, rng.choice([0, rng.randrange(6), rng.randrange(40)])) for c in range(120) for _ in range(rng.randrange(1, 7))}
    shared = Counter((a, b) for a, p in links for b, q in links if p == q and a != b)
    want = {}
    for (a, b), n in shared.items():
        want.setdefault(a, []).append((-n, b))
    want = {(a, b, -n) for a, x in want.items() for n, b in sorted(x)[:3]}
    x = X.suggestions(spark.createDataFrame(sorted(links), "claim_id long, part long"), 3)
    assert {(r.a, r.b, r.shared) for r in x.collect()} == want
    one_part = spark.range(20000).select(F.col("id").alias("claim_id"), F.lit(1).cast("long").alias("part"))
    assert X.suggestions(one_part, 3).count() == 60000  # 400 million pairs
