"""Candidate dedupe, decision clusters and the lease queue against plain loops."""

import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from claimforge.operators import candidates as D, decisions as K
from claimforge.streaming import leases as Q, streams as T

ROWS = "id long, scope string, text string, status string"


def words(text):
    return re.findall("[a-z0-9_]{2,}", (text or "").lower())


def best_by_hand(rows, k):
    """Every candidate against every row of its scope."""
    bags = {i: Counter(words(t)) for i, s, t, _ in rows if s and words(t)}
    n, total = len(bags), sum(sum(b.values()) for b in bags.values())
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: max(1.0, math.floor(1e6 * math.log((n - c + 0.5) / (c + 0.5)))) for t, c in df.items()}
    part = lambda b, t: math.floor(idf[t] * 2200.0 * b[t] / (b[t] + 1.2 * (0.25 + 0.75 * sum(b.values()) * n / total)))
    out = {}
    for i, s, t, status in rows:
        if status != "candidate" or i not in bags or len(t.strip(" ")) < 10:
            continue
        scores = {j: sum(c * part(bags[j], w) for w, c in bags[i].items() if w in bags[j]) for j, s2, _, st in rows if j in bags and j != i and s2 == s and st in D.CANONICAL}
        out[i] = [j for j in sorted(scores, key=lambda j: (-scores[j], j)) if set(bags[i]) & set(bags[j])][:k]
    return out


def made(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.35:  # copies, and copies with a word changed
            ws = words(rnd.choice(rows)[2]) or ["same"]
            if rnd.random() < 0.5:
                ws[rnd.randrange(len(ws))] = rnd.choice(vocabulary)
        else:
            ws = ["the"] * rnd.randint(1, 3) + rnd.choices(vocabulary, [1 / (r + 1) for r in range(60)], k=rnd.randint(1, 25))
        rows.append((i, rnd.choice("ab"), " ".join(ws).capitalize(), rnd.choice(["candidate", "candidate", "confirmed", "stale", "archived", "conflicted"])))
    return rows


@pytest.mark.parametrize("seed, work", [(1, 1), (2, 40), (3, 4000)])
def test_best_matches_equal_all_pairs_whatever_is_looked_up_first(spark, seed, work, monkeypatch):
    rows = made(seed, 150)
    plain = D.best_classes
    monkeypatch.setattr(D, "best_classes", lambda t, k: plain(t, k, work))
    got = {}
    for r in D.top_matches(*D.weighted_classes(spark.createDataFrame(rows, ROWS))).orderBy("rank").collect():
        got.setdefault(r.id, []).append(r.of)
    assert got == {i: m for i, m in best_by_hand(rows, 5).items() if m}


def test_candidates_are_folded_into_live_rows_only(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, "a", text, "archived"), (2, "a", text, "candidate"), (3, "a", text + " iota", "stale"), (4, "b", text, "candidate"), (5, "a", "tiny", "candidate"), (6, "a", None, "candidate"), (7, None, text, "candidate"), (8, "a", "nothing in common here", "candidate"), (9, "a", "!!! ??? !!! ???", "candidate"), (10, "b", text, "superseded")]
    got = {r.id: (r.action, r.canonical_id, r.reason) for r in D.judge(spark.createDataFrame(rows, ROWS), 0.85).collect()}
    assert got == {2: ("archive", 3, "near-duplicate"), 4: ("passthrough", None, "no-matches"), 5: ("passthrough", None, "text-too-short"), 6: ("passthrough", None, "text-too-short"), 7: ("passthrough", None, "no-matches"), 8: ("passthrough", None, "no-matches"), 9: ("passthrough", None, "no-matches")}


def test_many_copies_take_each_others_least_ids(spark):
    rows = [(i, "a", "one and the same long enough text", "candidate") for i in range(300)]
    got = {r.id: r.canonical_id for r in D.judge(spark.createDataFrame(rows, ROWS), 0.85).collect()}
    assert got == {i: 1 if i == 0 else 0 for i in range(300)}


def test_no_candidates(spark):
    assert D.judge(spark.createDataFrame([], ROWS), 0.85).count() == 0
    assert D.judge(spark.createDataFrame([(1, "a", "some words in here", "confirmed")], ROWS), 0.85).count() == 0


def tokens(text):
    return {w.strip("._-") for w in re.findall(r"[a-z][a-z0-9+._-]*", (text or "").lower()) if len(w.strip("._-")) >= 3 and w.strip("._-") not in K.STOP}


def clusters_by_hand(rows):
    low = {r[0]: r[0] for r in rows}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in combinations(rows, 2):
        x, y = tokens(a[3]), tokens(b[3])
        subject = (a[2] or "").strip().lower()
        if subject and subject == (b[2] or "").strip().lower() or x and y and len(x & y) >= min(2, len(x), len(y)):
            i, j = sorted((find(a[0]), find(b[0])))
            low[j] = i
    return {r[0]: find(r[0]) for r in rows}


CLAIMS = "id long, scope string, subject string, text string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_all_pairs(spark, seed):
    rnd = random.Random(seed)
    text = lambda: " ".join(rnd.choice(["the", "with", ""]) + f" term{rnd.randrange(150)}" for _ in range(rnd.choice([0, 1, 2, 3, 5])))
    rows = [(i, f"project:{rnd.randrange(3)}", rnd.choice([None, "", " Cache ", "cache", f"S{i % 40}"]) if rnd.random() < 0.3 else None, text() if rnd.random() < 0.95 else None) for i in range(120)]
    members = K.decision_members(spark.createDataFrame(rows, CLAIMS))
    got = {r.id: r.cluster for r in members.collect()}
    assert got == clusters_by_hand(rows) and 1 < len(set(got.values())) < 120


def test_report_ranks_by_claims_then_scopes(spark):
    rows = [(1, "p:a", None, "redis cache layer"), (2, "p:b", "Caching", "cache redis"), (3, "p:a", None, "postgres index"), (4, "p:a", None, "index postgres tuning"), (5, "p:a", "", ""), (6, "p:a", None, "lonely words sql")]
    got = [(r.rank, r.cluster, r.concept, r.claim_count, r.n_scopes, r.exemplars) for r in K.decision_report(K.decision_members(spark.createDataFrame(rows, CLAIMS))).orderBy("rank").collect()]
    assert got == [(1, 1, "Caching", 2, 2, [1, 2]), (2, 3, "Index + Postgres", 2, 1, [3, 4]), (3, 5, "Uncategorized", 1, 1, [5]), (4, 6, "Lonely + SQL + Words", 1, 1, [6])]


T0 = datetime(2024, 1, 1)
OPS = "job_id long, ts timestamp, seq long, op string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def queue(spark, path, batches, restart):
    """Operations as a stream with a batch for each list; ``restart`` runs the query anew, from its checkpoint, after each."""
    out, state, source = T.folder(spark, "q"), T.folder(spark, "q-state"), str(path / "in")
    got = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(source)
        if restart or i == len(batches) - 1:
            got = Q.run_queue(spark.readStream.schema(OPS).parquet(source), out, state)
    return got


def test_a_job_is_retried_with_growing_waits_and_blocked_after_five_attempts(spark, tmp_path):
    ops, minute = [(1, at(0), 0, "queue")], 0
    for k in range(5):
        ops += [(1, at(minute + 1), 1, "lease"), (1, at(minute + 2), 2, "retryable"), (1, at(minute + 2), 3, "lease")]  # the last one comes too early
        minute += 2 + 2**k
    changes = queue(spark, tmp_path, [ops + [(1, at(999), 4, "lease")]], False).orderBy("place").collect()
    assert [(r.status, r.attempts) for r in changes] == [("pending", 0)] + [x for k in range(1, 6) for x in (("leased", k), ("retryable" if k < 5 else "blocked", k))]
    waits = [(r.due - r.ts).total_seconds() for r in changes if r.status == "retryable"]
    assert waits == [60, 120, 240, 480]


@pytest.mark.parametrize("restart", [True, False])
def test_leases_run_out_by_timers_and_restarts_change_nothing(spark, tmp_path, restart):
    first = [(1, at(0), 0, "queue"), (1, at(1), 1, "lease"), (2, at(0), 2, "queue"), (2, at(1), 3, "lease"), (2, at(3), 4, "completed"), (3, at(2), 5, "lease"), (4, None, 6, "queue"), (None, at(1), 7, "queue"), (5, at(1), 8, None)]
    second = [(9, at(300), 0, "queue")]  # moves the watermark past job 1's lease
    third = [(1, at(301), 0, "lease"), (1, at(301), 1, "queue"), (2, at(302), 2, "lease"), (9, at(600), 3, "cancelled")]
    changes = queue(spark, tmp_path, [first, second, third], restart)
    got = {}
    for r in changes.orderBy("job_id", "place").collect():
        got.setdefault(r.job_id, []).append((r.status, r.attempts, r.cause))
    assert got == {
        1: [("pending", 0, "queue"), ("leased", 1, "lease"), ("retryable", 1, "lease_expired"), ("leased", 2, "lease"), ("retryable", 2, "lease_expired")],
        2: [("pending", 0, "queue"), ("leased", 1, "lease"), ("completed", 1, "completed")],
        9: [("pending", 0, "queue"), ("cancelled", 0, "cancelled")],
    }
    assert changes.filter("cause = 'lease_expired' AND job_id = 1").agg(F.min("ts")).first()[0] == at(6)


def test_last_states_take_back_leases_and_workers_take_due_jobs_in_order(spark):
    rows = [(1, 1, at(0), "leased", 2, "lease", None, at(5)), (2, 1, at(0), "leased", 5, "lease", None, at(5)), (3, 1, at(0), "leased", 1, "lease", None, at(50)), (4, 1, at(0), "retryable", 1, "retryable", at(20), None), (5, 1, at(0), "pending", 0, "queue", None, None)]
    state = Q.jobs(spark.createDataFrame(rows, Q.CHANGES), F.lit(at(10)))
    assert {r.job_id: r.status for r in state.collect()} == {1: "retryable", 2: "blocked", 3: "leased", 4: "retryable", 5: "pending"}
    due = lambda n, m: [r.job_id for r in Q.due_jobs(state.withColumn("stage", F.lit("s")), F.lit(at(m)), n).orderBy("rank").collect()]
    assert due(9, 10) == [1, 5] and due(1, 10) == [1] and due(9, 20) == [1, 4, 5]
