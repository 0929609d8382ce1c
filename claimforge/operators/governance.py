"""Governance jobs and analytics as set-based transforms of one snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Policy constants.
DECAY_RATES = {"low": 0.005, "medium": 0.02, "high": 0.05}
STALE_BELOW = 0.35
CADENCE_HOURS = {"low": 720.0, "medium": 168.0, "high": 24.0}
STATE_MULTIPLIER = {"confirmed": 1.0, "stale": 0.55, "conflicted": 0.35}
TIER_BONUS = {"core": 0.15, "working": 0.0, "peripheral": -0.10}
FRESHNESS_HOURS = {"low": 168.0, "medium": 72.0, "high": 24.0}
ARTICLE_DAYS, ARTICLE_FRESH, ARTICLE_STALE = 30.0, 0.5, 0.2


def choose(column: str, table: dict, default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(F.col(column) == k, F.lit(v)) if out is None else out.when(F.col(column) == k, F.lit(v))
    return out.otherwise(F.lit(default))


def hours(since: Column, now: Column) -> Column:
    """Hours from one timestamp to another, not below 0."""
    return F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", since, now) / F.lit(3600.0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def freshness(anchor: Column, now: Column) -> Column:
    return F.when(anchor.isNull(), F.lit(0.5)).otherwise(clamp(F.exp(-hours(anchor, now) / choose("volatility", FRESHNESS_HOURS, 72.0))))


def article_freshness(since: Column, now: Column) -> Column:
    """Exponential decay of an article by days since it was last renewed."""
    return F.exp(-hours(since, now) / 24.0 / ARTICLE_DAYS)


def freshness_bucket(score: Column) -> Column:
    return F.when(score >= ARTICLE_FRESH, "fresh").when(score >= ARTICLE_STALE, "mid").otherwise("stale")


def tier(access: Column, age_days: Column) -> Column:
    return F.when((access > 5) | (age_days < 7), "core").when((access == 0) & (age_days >= 90), "peripheral").otherwise("working")


def decay(claims: DataFrame, now: Column) -> DataFrame:
    """Confidence after linear decay by volatility; below the floor a claim turns stale. Stamps in the future are left alone."""
    days = hours(F.col("updated_at"), now) / 24.0
    new = F.greatest(F.lit(0.0), F.col("confidence") - choose("volatility", DECAY_RATES, 0.02) * days)
    x = claims.filter((F.col("status") == "confirmed") & ~F.col("pinned") & (F.col("updated_at") <= now))
    return x.withColumn("new_confidence", new).withColumn("new_status", F.when(F.col("new_confidence") < STALE_BELOW, "stale").otherwise(F.col("status")))


def edge_decay(weight: Column, days: Column, rate: float = 0.02, floor: float = 0.01) -> Column:
    return F.greatest(F.lit(floor), weight * F.exp(-rate * days))


def tiers(claims: DataFrame, now: Column) -> DataFrame:
    age = hours(F.col("updated_at"), now) / 24.0
    return claims.withColumn("tier", tier(F.col("access_count"), age))


def validation_score(n_citations: Column, text_length: Column, structured: Column, prior: Column) -> Column:
    raw = F.lit(0.35) + F.least(n_citations * 0.12, F.lit(0.4)) + F.least(text_length / 240.0, F.lit(0.15)) + F.when(structured, 0.1).otherwise(0.0)
    return clamp(raw * 0.75 + prior * 0.25)


def priors(ledger: DataFrame) -> DataFrame:
    """Validator outcomes by kind of claim: attempts, validated, rate; blank kinds are uncategorized."""
    won = (F.col("to_status") == "confirmed").cast("long")
    kind = F.when(F.col("raw_type").isNull() | (F.trim("raw_type") == ""), "uncategorized").otherwise(F.col("raw_type"))
    return ledger.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("attempts"), F.sum(won).alias("validated")).withColumn("rate", F.round(F.col("validated") / F.col("attempts"), 4))


def provenance(claims: DataFrame, now: Column) -> DataFrame:
    """Per agent: totals by status, the last creation, and those of the last 30 days; archived ones left out."""
    agent = F.when(F.col("source_agent").isNull() | (F.trim("source_agent") == ""), "<null>").otherwise(F.col("source_agent"))
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    recent = F.count_if(F.col("created_at") >= now - F.make_dt_interval(F.lit(30))).alias("recent")
    return claims.filter("status <> 'archived'").groupBy(agent.alias("agent")).agg(F.count(F.lit(1)).alias("total"), *[n(s) for s in ("candidate", "confirmed", "stale", "superseded", "conflicted")], F.max("created_at").alias("last_created"), recent)


def latency_percentiles(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """p50, p95, p99 (linear interpolation) of the days from a claim to its first citation, floored at 0."""
    first = citations.groupBy("claim_id").agg(F.min("created_at").alias("at"))
    x = claims.join(first, claims.id == first.claim_id).select((hours(F.col("created_at"), F.col("at")) / 24.0).alias("days"))
    p = x.agg(F.percentile("days", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.count(F.lit(1)).alias("n"))
    return p.select("n", *[F.round(F.element_at("p", i + 1), 6).alias(c) for i, c in enumerate(("p50", "p95", "p99"))])


def nearest_rank(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank percentiles with count, min and max."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def quality_scores(claims: DataFrame, retrievals: DataFrame, now: Column) -> DataFrame:
    """Usage quality of each claim: retrievals, accesses, freshness of use, and disuse."""
    r = retrievals.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    x = claims.join(r, claims.id == r.claim_id, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    age = F.floor(hours(F.col("created_at"), now) / 24.0)
    q = F.lit(0.5) + F.least(F.col("n") * 0.05, F.lit(0.3)) + F.least(F.col("access_count") * 0.03, F.lit(0.2)) + F.when((F.col("access_count") > 0) & (age < 7), 0.1).otherwise(0.0) - F.when((F.col("access_count") == 0) & (F.col("n") == 0) & (age > 30), 0.1).otherwise(0.0)
    return x.select("id", F.col("n").alias("retrievals"), F.round(clamp(q), 6).alias("quality"))


def conflict_groups(claims: DataFrame) -> DataFrame:
    """Keys whose claims disagree: two or more rows and more than one normalised value."""
    return claims.groupBy("subject", "predicate", "scope").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower(F.trim("object_value"))).alias("n_values")).filter("n > 1 AND n_values > 1")


def conflict_winners(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """For every loser of a disagreeing group its winner and the first rule that decides: pinned, confidence, recency, citations, id."""
    n = citations.groupBy("claim_id").agg(F.count(F.lit(1)).alias("cites"))
    x = claims.join(n, claims.id == n.claim_id, "left").withColumn("cites", F.coalesce("cites", F.lit(0)))
    key = ["subject", "predicate", "scope"]
    every = W.partitionBy(*key)
    order = every.orderBy(F.desc("pinned"), F.desc("confidence"), F.desc("updated_at"), F.desc("cites"), F.desc("id"))
    x = x.withColumn("_values", F.size(F.collect_set(F.lower(F.trim("object_value"))).over(every)))
    best = F.first(F.struct("id", "pinned", "confidence", "updated_at", "cites")).over(order)
    x = x.filter("_values > 1").withColumn("w", best).filter("id <> w.id")
    reason = F.when(F.col("w.pinned") != F.col("pinned"), "pinned_wins").when(F.col("w.confidence") != F.col("confidence"), "higher_confidence").when(F.col("w.updated_at") != F.col("updated_at"), "more_recent").when(F.col("w.cites") != F.col("cites"), "more_citations").otherwise("higher_id_tiebreaker")
    return x.select(F.col("id").alias("loser_id"), F.col("w.id").alias("winner_id"), reason.alias("reason"))


def review_queue(claims: DataFrame, now: Column) -> DataFrame:
    weight = F.when(F.col("status") == "conflicted", 0.55).when(F.col("status") == "stale", 0.40).otherwise(0.15)
    p = weight + (1.0 - clamp(F.col("confidence"))) * 0.35 + 0.20 * F.exp(-hours(F.col("updated_at"), now) / 48.0)
    return claims.filter(F.col("status").isin("conflicted", "stale")).select("id", "status", F.round(p, 6).alias("priority"))


def revalidation_due(claims: DataFrame, now: Column) -> DataFrame:
    cadence = F.greatest(F.lit(1.0), choose("volatility", CADENCE_HOURS, 168.0) * choose("status", STATE_MULTIPLIER, 1.0))
    age = hours(F.col("updated_at"), now)
    bonus = F.when(F.col("status") == "stale", 0.25).when(F.col("status") == "conflicted", 0.4).otherwise(0.0) + (1.0 - clamp(F.col("confidence"))) * 0.2 + F.when(F.col("volatility") == "high", 0.2).when(F.col("volatility") == "medium", 0.1).otherwise(0.0)
    return claims.filter(F.col("status").isin("confirmed", "stale", "conflicted") & (age >= cadence)).select("id", F.round(age / cadence + bonus, 6).alias("priority"))


def latest_per_key(claims: DataFrame) -> DataFrame:
    return claims.groupBy("subject", "predicate").agg(F.max_by("id", F.struct("updated_at", "id")).alias("id"), F.max("updated_at").alias("updated_at"))


def durative_states(claims: DataFrame) -> DataFrame:
    """Span of a state: earliest start, latest end unless one is open."""
    return claims.groupBy("subject", "predicate").agg(F.min("valid_from").alias("valid_from"), F.when(F.count("valid_until") == F.count(F.lit(1)), F.max("valid_until")).alias("valid_until"), F.count(F.lit(1)).alias("n"))


def episodes(turns: DataFrame, most: int) -> DataFrame:
    """First ``most`` turns of a session as an episode with a stable id; recurring if more than one role speaks."""
    w = W.partitionBy("session_id").orderBy("id")
    x = turns.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda v: v.cast("string")), ",")
    return x.groupBy("session_id").agg(ids.alias("_ids"), F.count(F.lit(1)).alias("n"), (F.countDistinct("role") > 1).alias("recurring")).select("session_id", "n", "recurring", F.substring(F.sha2(F.col("_ids").cast("binary"), 256), 1, 16).alias("episode_id"))


def promotion_ladder(claims: DataFrame, citations: DataFrame, threshold: float = 0.58, margin: float = 0.08) -> DataFrame:
    """Candidates against one snapshot: needs citations and score; a same-valued rival makes it a duplicate, a close one a conflict."""
    n = citations.groupBy("claim_id").agg(F.count(F.lit(1)).alias("cites"))
    cand = claims.filter("status = 'candidate'").join(n, F.col("id") == F.col("claim_id"), "left").withColumn("cites", F.coalesce("cites", F.lit(0))).drop("claim_id")
    cand = cand.withColumn("score", validation_score(F.col("cites"), F.length("predicate") + F.length("object_value"), F.lit(True), F.col("confidence")))
    rivals = claims.filter("status = 'confirmed'").groupBy(F.col("subject").alias("rs"), F.col("predicate").alias("rp"), F.col("scope").alias("rc")).agg(F.max_by(F.struct("id", "object_value", "confidence"), F.struct("confidence", "updated_at", "id")).alias("r"))
    x = cand.join(rivals, (F.col("subject") == F.col("rs")) & (F.col("predicate") == F.col("rp")) & (F.col("scope") == F.col("rc")), "left")
    same = F.lower(F.trim("object_value")) == F.lower(F.trim("r.object_value"))
    verdict = F.when((F.col("cites") == 0) | (F.col("score") < threshold), "pending").when(F.col("r.id").isNull(), "confirmed").when(same, "duplicate").when(F.col("score") <= F.col("r.confidence") + margin, "conflicted").otherwise("supersedes")
    return x.select("id", "cites", F.round("score", 6).alias("score"), F.col("r.id").alias("rival_id"), verdict.alias("verdict"))


def steward_decisions(claims: DataFrame) -> DataFrame:
    """A newer confirmed rival supersedes; conflicts and stale states are reported; the rest is kept."""
    newest = claims.filter("status = 'confirmed'").groupBy(F.col("subject").alias("rs"), F.col("predicate").alias("rp"), F.col("scope").alias("rc")).agg(F.max(F.struct("updated_at", "id")).alias("m"))
    x = claims.filter("status <> 'archived'").join(newest, (F.col("subject") == F.col("rs")) & (F.col("predicate") == F.col("rp")) & (F.col("scope") == F.col("rc")), "left")
    d = F.when((F.col("m.id") != F.col("id")) & (F.col("m.updated_at") > F.col("updated_at")), "superseded_candidate").when(F.col("status") == "conflicted", "conflict").when(F.col("status") == "stale", "stale").otherwise("keep")
    return x.select("id", d.alias("decision"))


def scope_status_rollup(claims: DataFrame) -> DataFrame:
    """Subtotals by scope and status; an addition of this library."""
    return claims.rollup("scope", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def coverage_gaps(claims: DataFrame, jobs: DataFrame) -> DataFrame:
    """Confirmed claims without a job for them, by scope."""
    done = jobs.select(F.col("claim_id").alias("c")).distinct()
    return claims.filter("status = 'confirmed'").join(done, F.col("id") == F.col("c"), "left").groupBy("scope").agg(F.count(F.lit(1)).alias("confirmed"), F.count_if(F.col("c").isNull()).alias("missing"))


def status_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.groupBy("status").agg(F.count(F.lit(1)).alias("n_before"))
    b = after.groupBy("status").agg(F.count(F.lit(1)).alias("n_after"))
    x = a.join(b, "status", "full_outer").fillna(0, ["n_before", "n_after"])
    return x.withColumn("change", F.col("n_after") - F.col("n_before"))


def tally_confidence(n: Column) -> Column:
    return F.lit(0.4) + 0.3 * F.least(n / 3.0, F.lit(1.0))


def retention(turns: DataFrame, keep_sessions: int, max_chars: int) -> DataFrame:
    """Sessions beyond the newest ``keep_sessions``, then the oldest turns until the rest fits: running sums, not a loop.

    Only the newest ``keep_sessions`` rows, one a session, are ordered in one place: a bounded top-k.
    """
    s = turns.groupBy("session_id").agg(F.sum(F.length("content")).alias("chars"), F.max("id").alias("last"))
    top = s.orderBy(F.desc("last")).limit(keep_sessions)
    kept = top.select("session_id", F.sum("chars").over(W.orderBy(F.desc("last")).rowsBetween(W.unboundedPreceding, 0)).alias("newer"))
    out = s.join(kept, "session_id", "left")
    return out.select("session_id", "chars", F.when(F.col("newer").isNull(), "old_session").when(F.col("newer") > max_chars, "over_budget").otherwise("kept").alias("plan"))
