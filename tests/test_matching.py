"""Bitemporal upserts, similarity joins, guarded aliases and best matches against plain loops."""

import difflib
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimforge.operators import bitemporal as B, matching as M
from claimforge.streaming.streams import folder

KIND = "key string, id long, seq long, valid_from timestamp_ntz, valid_until timestamp_ntz"
DAY0 = datetime(2020, 1, 1)


def day(n):
    return None if n is None else DAY0 + timedelta(days=n)


def on_line(versions):
    """(key, day) -> id of the newest version, by asking every version for every day."""
    out = {}
    for key, i, seq, a, b in versions:
        for t in range(a, 140 if b is None else b):
            if (key, t) not in out or out[key, t] < (seq, i):
                out[key, t] = (seq, i)
    return {k: w[1] for k, w in out.items()}


def flattened(rows):
    out, spans = {}, {}
    for r in rows:
        a = (r.valid_from - DAY0).days
        b = 140 if r.valid_until is None else (r.valid_until - DAY0).days
        spans.setdefault(r.key, []).append((a, b, r.id))
        for t in range(a, b):
            assert (r.key, t) not in out, "two versions at one time"
            out[r.key, t] = r.id
    for s in spans.values():
        s.sort()
        assert all(not (x[1] == y[0] and x[2] == y[2]) for x, y in zip(s, s[1:], strict=False)), "neighbours of one version are one row"
    return out


def made(rng, n, seq):
    """A third of all rows and more are of one key; some are open, some have no length."""
    out = []
    for i in range(n):
        a = rng.randrange(100)
        b = None if rng.random() < 0.15 else a + rng.randrange(40)
        out.append((rng.choice(["hot", "hot", "k1", "k2", "k3"]), 1000 * seq + i, seq, a, b))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, i, s, day(a), day(b)) for k, i, s, a, b in rows], KIND)


def test_time_line_equals_a_loop_over_batches_in_any_order_and_replays(spark):
    rng = random.Random(5)
    batches = [made(rng, 60, s) for s in (2, 1, 3)]  # the second batch was recorded before the first
    store = B.open_store(spark, folder(spark, "t"), frame(spark, []))
    for n, rows in enumerate(batches):
        B.upsert(store, frame(spark, rows), f"b{n}")
    version = store.last()
    t = store.read(version)
    every = [v for rows in batches for v in rows]
    assert flattened(t["timeline"].collect()) == on_line(every)
    assert t["versions"].count() == len(every)
    B.upsert(store, frame(spark, batches[0]), "b0")  # the same batch
    assert store.last() == version
    B.upsert(store, frame(spark, batches[0]), "again")  # the same rows under another name
    t = store.read(store.last())
    assert t["versions"].count() == len(every) and flattened(t["timeline"].collect()) == on_line(every)


def test_a_failing_batch_leaves_the_version_before(spark):
    store = B.open_store(spark, folder(spark, "t"), frame(spark, []))
    B.upsert(store, frame(spark, [("k", 1, 1, 0, None)]), "first")
    bad = frame(spark, [("k", 2, 2, 5, 9)]).withColumn("id", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        B.upsert(store, bad, "second")
    assert [(r.id, r.valid_until) for r in store.read(store.last())["timeline"].collect()] == [(1, None)]
    B.upsert(store, frame(spark, [("k", 2, 2, 5, 9)]), "second")
    rows = sorted((r.valid_from, r.id, r.valid_until) for r in store.read(store.last())["timeline"].collect())
    assert rows == [(day(0), 1, day(5)), (day(5), 2, day(9)), (day(9), 1, None)]  # split


def test_empty_tables_and_rows_of_no_length(spark):
    assert B.timeline(frame(spark, [])).collect() == []
    assert B.timeline(frame(spark, [("k", 1, 1, 4, 4)])).collect() == []
    keys = spark.createDataFrame([(None, "a"), ("a", None), ("", "a")], "x string, y string").select(B.identity("x", "y").alias("k"))
    assert keys.distinct().count() == 3 and keys.filter("k IS NULL").count() == 0


def test_guard_of_bounds(spark):
    rows = [
        ("2024-01-02", "2024-01-01", "inverted", None),
        ("2024-01-01", "2024-01-01T00:00:00Z", None, datetime(2024, 1, 1)),
        ("yesterday", None, "malformed", None),
        (None, "2023-13-01", "malformed", None),
        (None, "2023-05-01T02:00:00+02:00", None, datetime(2023, 5, 1)),  # an end in the past alone: no length
        (None, "2030-01-01", None, datetime(2025, 1, 1)),
        (" ", None, None, datetime(2025, 1, 1)),
        ("2024-01-01T05:30:00.250000+0530", None, None, datetime(2024, 1, 1, 0, 0, 0, 250000)),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(rows)], "id int, valid_from string, valid_until string")
    got = {r.id: r for r in B.guarded(df, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).collect()}
    for i, (_, _, fault, since) in enumerate(rows):
        assert got[i].fault == fault, i
        if fault is None:
            assert got[i].valid_from == since, i
            assert got[i].valid_until is None or got[i].valid_until >= since


def pairs_by_loop(docs, least):
    n, df = len(docs), Counter(t for d in docs.values() for t in d)
    unit = {}
    for i, d in docs.items():
        w = {t: c * math.log((1 + n) / (1 + df[t])) for t, c in d.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        unit[i] = {t: x / norm for t, x in w.items()} if norm else {}
    out = {}
    for a in docs:
        for b in docs:
            if a < b:
                cos = sum(x * unit[b].get(t, 0) for t, x in unit[a].items())
                if cos >= least:
                    out[a, b] = round(cos, 6)
    return out


@pytest.mark.parametrize("least", [0.1, 0.4, 0.8])
def test_similar_texts_equal_all_pairs(spark, least):
    """With a term of every document, one of nearly every document, copies, and a document of common terms only."""
    rng = random.Random(7)
    docs = {}
    for i in range(80):
        if i % 9 == 4:
            docs[i] = docs[i - rng.randrange(1, 4)].copy()
            docs[i][f"own{rng.randrange(3)}"] += rng.randrange(2)
        else:
            docs[i] = Counter(["all", "most"] + [f"w{int(rng.random() ** 2 * 40)}" for _ in range(rng.randrange(1, 14))])
        docs[i] += Counter()
    docs[80], docs[81], docs[82] = Counter(["all"]), Counter(["all", "most"]), docs[0].copy()
    terms = spark.createDataFrame([(i, t, c) for i, d in docs.items() for t, c in d.items()], "id long, term string, tf long")
    rows = M.similar_texts(terms, F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))), least).collect()
    rep = {}
    for i, d in sorted(docs.items()):
        rep[i] = next((j for j in sorted(docs) if docs[j] == d), i)
    want = {p: c for p, c in pairs_by_loop(docs, least).items() if rep[p[0]] == p[0] and rep[p[1]] == p[1]}
    got = {(r.a, r.b): r.cos for r in rows}
    assert set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 2e-6 for p in want)
    sizes = Counter(rep.values())
    assert all((r.n_a, r.n_b) == (sizes[r.a], sizes[r.b]) for r in rows)
    assert {(r.id, r.of) for r in M.classes(terms).collect()} == set(rep.items())


def resolved_by_loop(registry, alias):
    best = {}
    for entity, known in registry:
        if known and alias:
            best[entity] = max(best.get(entity, 0.0), difflib.SequenceMatcher(None, known, alias).ratio())
    ranked = sorted(best.values(), reverse=True)
    if not ranked or ranked[0] < 0.82:
        return 0
    if len(ranked) > 1 and ranked[0] - ranked[1] <= 0.05:
        return -1
    return next(e for e, s in best.items() if s == ranked[0])


def test_guarded_aliases_equal_the_matcher_over_all_pairs(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdeo-") for _ in range(n))
    registry = [(e, word(rng.choice([1, 2, 3, 4, 5, 8, 12, 20, 40]))) for e in range(1, 60) for _ in range(2)]
    registry += [(70, "qdrant-cloud"), (71, "quadrant-cloud"), (72, ""), (73, None), (74, "x" * 200), (75, "x" * 150 + "y" * 50)]
    mentions = [None, "", "qdrant-clouds", "postgres", "x" * 199]
    for _, known in registry[:118]:
        s = list(known)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(2)] = rng.choice(["", "a", "zz"])
        mentions.append("".join(s))
    mentions += [word(rng.randrange(1, 14)) for _ in range(60)]
    got = M.resolve_aliases(spark.createDataFrame(registry, "entity_id long, alias string"), spark.createDataFrame([(m,) for m in mentions], "alias string")).collect()
    assert {r.alias: r.entity_id for r in got} == {m: resolved_by_loop(registry, m) for m in {m or "" for m in mentions}}
    assert len(got) == len({m or "" for m in mentions})
    assert {-1, 0} < {r.entity_id for r in got}
    none = M.resolve_aliases(spark.createDataFrame([], "entity_id long, alias string"), spark.createDataFrame([("a",)], "alias string")).collect()
    assert [(r.alias, r.entity_id) for r in none] == [("a", 0)]
