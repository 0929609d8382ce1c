"""Inbox tails, first-fit clusters, the cycle and evaluations against plain Python."""

import json

import pytest

from claimforge.streaming import inbox as I


def lines_of(spark, out):
    return sorted((r.line for r in spark.read.schema(f"{I.LINES}, batch int").parquet(out).collect()))


def test_a_growing_file_gives_each_line_once(spark, tmp_path):
    box, out, state = tmp_path / "in.jsonl", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        I.drain(I.tail(spark, str(box), range_bytes=64), out, state)  # many ranges, and a new query every time

    first = [f"line {i} é" * (i % 4 + 1) for i in range(40)]
    box.write_text("\n".join(first) + "\n\nhalf a li", encoding="utf-8")
    run()
    assert lines_of(spark, out) == sorted(first)
    run()
    assert lines_of(spark, out) == sorted(first)
    with box.open("a", encoding="utf-8") as f:
        f.write("ne\r\nnext\n")
    run()
    assert lines_of(spark, out) == sorted([*first, "half a line", "next"])
    box.write_text("short\n")  # truncated
    run()
    assert lines_of(spark, out) == sorted([*first, "half a line", "next", "short"])
    box.write_text("other\n" * 3)  # replaced by a longer file
    run()
    assert lines_of(spark, out) == sorted([*first, "half a line", "next", "short", *["other"] * 3])


def test_turns_are_processed_once_and_judged(spark, tmp_path):
    box, root, state = tmp_path / "box", str(tmp_path / "root"), str(tmp_path / "state")
    box.mkdir()
    know = spark.createDataFrame([(1, "confirmed", "deploy server alpha", True), (2, "stale", "billing contact", True), (3, "confirmed", "hidden billing", False)], "id long, status string, text string, visible boolean")

    def turn(n, user, assistant=None, notes=None):
        return json.dumps({"session_id": "s", "thread_id": "t", "turn_id": str(n), "user_text": user, "assistant_text": assistant, "observations": notes}) + "\n"

    (box / "a").write_text(turn(1, "Where is server alpha? <private>10.9.9.9</private>", "The server address is 10.0.0.7", ["seen", " "]) + "{broken\n")
    I.process(I.tail(spark, str(box)), know, root, state)
    with (box / "a").open("a") as f:
        f.write(turn(2, "billing?", "The server address is 10.0.0.7") + turn(3, "nothing known", "It is at 10.0.0.8"))
    I.process(I.tail(spark, str(box)), know, root, state)
    turns = {r.turn_key: (r.n_evidence, r.tier, r.retrieved) for r in spark.read.parquet(f"{root}/turns").collect()}
    assert turns == {"s/t/1": (3, "tier1", [1]), "s/t/2": (2, "tier2", [2]), "s/t/3": (2, "tier2", [])}
    claims = sorted((r.value, len(r.citations), r.citations[1].locator, r.status) for r in spark.read.parquet(f"{root}/claims").collect())
    assert [c[:3] for c in claims] == [("10.0.0.7", 3, "session=s;thread=t;turn=1;evidence=1"), ("10.0.0.8", 2, "session=s;thread=t;turn=3;evidence=1")]
    assert spark.read.parquet(f"{root}/quarantine").select("line").first()[0] == "{broken"


def plain_first_fit(rows, threshold):
    """Members in order for each cluster of one run, by plain loops."""
    clusters, cents = [], []
    for i, s, v in rows:
        if v is None:
            continue
        for c, m in enumerate(cents):
            dot = sum(a * b for a, b in zip(v, m))
            if dot / (sum(a * a for a in v) * sum(a * a for a in m)) ** 0.5 >= threshold:
                clusters[c].append((i, s))
                n = len(clusters[c])
                cents[c] = [(a * (n - 1) + b) / n for a, b in zip(m, v)]
                break
        else:
            clusters.append([(i, s)])
            cents.append(list(v))
    for i, s, v in rows:
        if v is None:
            home = next((c for c in clusters if any(s and o and s.strip().lower() == o.strip().lower() for _, o in c)), None)
            if home is None:
                clusters.append([(i, s)])
            else:
                home.append((i, s))
    return [[i for i, _ in c] for c in clusters]


@pytest.mark.parametrize("threshold", [0.05, 0.3])
def test_first_fit_equals_plain_loops(spark, threshold):
    from claimforge.plans import operations as P
    from claimforge.operators import clusters as C

    x = P._vectors(spark, "/root/testdata/sf0.001").select("id", "scope", "subject", "v")
    groups = {}
    for r in x.orderBy("id").collect():
        groups.setdefault((r.scope, r.id // 100), []).append((r.id, r.subject, r.v))
    want = sorted((k[0], k[1], i, c[0], p) for k, rows in groups.items() for c in plain_first_fit(rows, threshold) for p, i in enumerate(c))
    assert sorted(tuple(r) for r in C.first_fit(x.repartition(3), threshold, run=100).collect()) == want


def test_summaries_have_members_text_and_citations(spark):
    from pyspark.sql import functions as F

    from claimforge.operators import clusters as C

    claims = spark.createDataFrame([(i, 1, f"S{i % 2}", "p", None, f"text {i} " + "x" * 400, [1.0, 0.0] if i < 30 else [0.0, 1.0]) for i in range(32)], "id long, scope int, subject string, predicate string, value string, text string, v array<double>")
    cites = spark.createDataFrame([(0, "a", "1"), (1, "a", "1"), (1, "b", "2"), (25, "c", "3"), (31, "d", "4")], "claim_id long, source string, locator string")
    out = C.summaries(claims, C.first_fit(claims), cites, lambda b: F.upper(F.substring(b, 1, 12)), lambda b: F.regexp_replace(b, "text", "note")).orderBy("part").collect()
    assert [(r.cluster, r.part, r.source_ids, r.citations) for r in out] == [(0, 0, list(range(20)), 2), (0, 1, list(range(20, 30)), 1)]
    assert out[0].summary == "[1] | SUBJEC" and "Text: note 0 xx" in out[0].block and "Value" not in out[0].block and max(map(len, out[0].block.split("\n"))) < 360


def test_hubs_tie_nothing_and_bounds_hold(spark):
    from claimforge.operators import observations as O

    def row(claim, evidence, signature, scope="a"):
        return (scope, claim, evidence, signature)

    eligible = [row(1, 1, "x"), row(2, 2, "x"), row(2, 2, "y"), row(3, 1, "y")]
    split = eligible + [row(c + 10, e + 10, s + "2") for _, c, e, s in eligible]
    hub = [row(i, i, "h") for i in range(1, 22)]
    chain = [row(i, i, f"s{i}") for i in range(1, 22)] + [row(i, i, f"s{i - 1}") for i in range(2, 22)]
    cases = {"eligible": (eligible, {"eligible": 1}), "split": (split, {"eligible": 2}), "hub": (hub, {"below_eligibility_threshold": 21}), "oversized": (chain, {"component_oversized": 1}), "few": (eligible[:2], {"below_eligibility_threshold": 1}), "scopes": (eligible + [row(*r[1:], scope="b") for r in eligible], {"eligible": 2})}
    for name, (rows, want) in cases.items():
        got = O.discover(spark.createDataFrame(rows, "scope string, claim_id long, evidence long, signature string")).select("component", "code").distinct().groupBy("code").count().collect()
        assert {r.code: r["count"] for r in got} == want, name
    assert O.hubs(spark.createDataFrame(hub, "scope string, claim_id long, evidence long, signature string")).collect()[0].episodes == 21


def test_agreement_counts(spark):
    from claimforge.operators import observations as O

    frame = lambda groups: spark.createDataFrame([(g, c) for g, cs in groups.items() for c in cs], "`group` string, claim_id long")
    got = O.agreement(frame({"a": [1, 2], "b": [3], "c": [4, 5, 6, 7], "d": [90]}), frame({"A": [1, 2], "B": [3, 4], "C": [5, 6], "D": [80, 81]})).first()
    assert (got.exact, got.expected, got.found, got.missed, got.extra, got.split, got.merged, got.precision, got.recall) == (1, 4, 4, 1, 1, 1, 1, 0.25, 0.25)


def test_a_cycle_step_commits_or_leaves_the_version_before(spark, tmp_path):
    from pyspark.sql import functions as F

    from claimforge.operators import cycle as Y

    claims = spark.createDataFrame([(1, "candidate"), (2, "confirmed")], "id long, status string")
    store = Y.start(spark, str(tmp_path / "store"), {"claims": claims})

    def confirm(t):
        return {"claims": t["claims"].withColumn("status", F.lit("confirmed"))}

    def torn(t):
        return {"claims": t["claims"].withColumn("status", F.lit("archived")), "other": t["claims"].select(F.raise_error(F.lit("torn")).alias("x"))}

    def count(t):
        return {"n": t["claims"].groupBy("status").count()}

    manifest = Y.run_cycle(store, [Y.Job("confirm", confirm), Y.Job("torn", torn, isolated=True), Y.Job("count", count)])
    steps = {r.step: (r.version, r.error) for r in manifest.select("step", "version", "error").distinct().collect()}
    assert steps["confirm"] == (1, None) and steps["torn"][0] == 2 and "torn" in steps["torn"][1] and steps["count"] == (3, None)
    assert [tuple(r) for r in store.read(3)["n"].collect()] == [("confirmed", 2)]
    assert [tuple(r) for r in store.read(3)["transitions"].collect()] == [("confirm", 1, "candidate", "confirmed")]
    assert {r.status for r in store.read(0)["claims"].collect()} == {"candidate", "confirmed"}
    with pytest.raises(Exception, match="torn"):
        Y.run_cycle(store, [Y.Job("torn", torn), Y.Job("count", count)])
    assert store.last() == 3


def plain_admission(rows, budget):
    """The loop: rows in order, each against all admitted ones."""
    import re

    admitted, out, by_id = [], {}, {}
    for i, _, text, evidence, confidence, *key in sorted(rows, key=lambda r: (r[1], r[0])):
        words = re.findall("[a-z0-9_]+", (text or "").lower())
        s, reasons = set(words), []
        if any(words == w for _, w in admitted):
            reasons.append("redundant")
        elif s and any(len(s & set(w)) >= 0.8 * len(s | set(w)) for _, w in admitted):
            reasons.append("near_duplicate")
        if evidence <= 0 or confidence < 0.6:
            reasons.append("weak_support")
        if not reasons and len(admitted) >= budget:
            reasons.append("budget_limit")
        if not reasons:
            admitted.append((i, words))
        out[i], by_id[i] = (not reasons, reasons), key
    groups = {}
    for i, _ in admitted:
        if by_id[i][0] and by_id[i][1]:
            groups.setdefault(tuple(by_id[i][:2]), []).append(i)
    for ids in groups.values():
        if len({by_id[i][2] for i in ids}) > 1:
            for i in ids:
                out[i] = (True, ["lifecycle_conflict"])
    return out


@pytest.mark.parametrize("budget", [1000, 40, 3])
def test_admission_equals_the_loop(spark, budget):
    import random

    from claimforge.operators import admission as M

    rng, rows, words = random.Random(9), [], [f"w{i}" for i in range(60)]
    for i in range(160):
        if i and rng.random() < 0.6:  # drifting copies make chains
            w = rng.choice(rows)[2].split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.2:
                rng.shuffle(w)
        else:
            w = [rng.choice(words) for _ in range(rng.randint(1, 14))]
        rows.append((i, rng.randint(0, 40), " ".join(w), rng.randint(0, 6), rng.choice([0.5, 0.6, 0.9]), rng.choice(["", "s", "t"]), "p", str(rng.randint(0, 3))))
    rows += [(200, 0, "", 1, 0.9, "s", "p", "1"), (201, 1, " !", 1, 0.9, "s", "p", "1"), (202, 2, "", 0, 0.9, "s", "p", "1")]
    df = spark.createDataFrame(rows, "id long, rank int, text string, evidence int, confidence double, subject string, predicate string, value string").repartition(3)
    assert {r.id: (r.admitted, r.reasons) for r in M.admit(df, budget).collect()} == plain_admission(rows, budget)


def test_tampered_chains_are_reported_with_their_positions(spark, tmp_path):
    from pyspark.sql import functions as F

    from claimforge.operators import chain as H

    rows = [(i, i % 3, "decay", "a", None if i % 4 else "b", None, '{"b": 1, "a": %d}' % i if i % 5 else "not json", f"t{i}") for i in range(30)]
    made = H.build(spark.createDataFrame(rows, "id long, claim_id long, event_type string, from_status string, to_status string, details string, payload string, created_at string").repartition(4))
    made.write.parquet(str(tmp_path / "c"))
    chain = spark.read.parquet(str(tmp_path / "c"))
    assert H.verify(chain).count() == 0 and chain.filter("payload = '{\"a\":3,\"b\":1}'").count() == 1
    faults = lambda df: sorted((r.claim_id, r.position, r.id, r.fault) for r in H.verify(df).collect())
    assert faults(chain.withColumn("to_status", F.when(F.col("id") == 9, "x").otherwise(F.col("to_status")))) == [(0, 4, 9, "edited")]
    assert faults(chain.filter("id <> 10")) == [(1, 4, 13, "missing")]
    swapped = chain.withColumn("id", F.when(F.col("id") == 11, 14).when(F.col("id") == 14, 11).otherwise(F.col("id")))
    assert faults(swapped) == [(2, 4, 11, "reordered"), (2, 5, 14, "reordered"), (2, 6, 17, "reordered")]
    assert faults(chain.filter("id <> 0")) == [(0, 1, 3, "missing")]
