"""Lifecycle jobs: ingest, extraction, validation, compaction, redaction, merging and their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimforge.functions import text as T

ROLES = {"admin": {"read", "write", "govern", "erase"}, "writer": {"read", "write"}, "reader": {"read"}}


def allowed(role: str, action: str) -> bool:
    return action in ROLES.get(role, set())


def search_text(query: str, most: int = 12) -> str:
    """Words of two characters or more without stop words; under five an AND of the raw query, else an OR of them."""
    import re

    seen = [t for t in dict.fromkeys(re.findall(r"[\w-]+", query.lower())) if len(t) >= 2 and t not in T.RANK_STOP][:most]
    return query.strip() if len(seen) < 5 else " OR ".join(seen)


def ingest(new: DataFrame, have: DataFrame, most_per_batch: int) -> DataFrame:
    """Candidates by content key: within the batch the first, against what is there by anti-join, at most ``most_per_batch`` an agent."""
    x = new.withColumn("key", T.content_key(F.col("text"), F.col("scope"), F.lit("default")))
    x = x.groupBy("key").agg(F.min_by(F.struct("id", "scope", "source_agent"), "id").alias("x")).select("key", "x.*")
    x = x.join(have.select(T.content_key(F.col("text"), F.col("scope"), F.lit("default")).alias("key")), "key", "left_anti")
    return x.withColumn("r", F.row_number().over(W.partitionBy("source_agent").orderBy("id"))).filter(F.col("r") <= most_per_batch).drop("r")


def mutable_state(text: Column, volatility: Column, open_ended: Column) -> Column:
    """Volatility, forced high for texts on operational state without an end."""
    is_state = F.lower(text).rlike(r"\b(server|port|service|host|deploy)\b") & F.lower(text).rlike(r"\b(running|down|up|busy|failing|current|currently)\b")
    return F.when(is_state & open_ended, "high").otherwise(volatility)


def foreign_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Orphans of one foreign key and how many rows they are."""
    lost = child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")
    return lost.groupBy(F.col(key).cast("long").alias("missing")).agg(F.count(F.lit(1)).alias("rows")).withColumn("fk", F.lit(name))


def stale_by_files(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Claims that cite a source changed after the citation."""
    return citations.join(files, "source").filter(F.col("changed_at") > F.col("created_at")).groupBy("claim_id").agg(F.countDistinct("source").alias("changed_sources"))


def compaction(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """A summary per (subject, predicate, scope) of retired claims: members, their citations, status histogram."""
    retired = claims.filter(F.col("status").isin("stale", "superseded", "conflicted") & ~F.col("pinned"))
    n = citations.groupBy("claim_id").agg(F.count(F.lit(1)).alias("k"))
    x = retired.join(n, retired.id == n.claim_id, "left")
    members = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda v: v.cast("string")), ",")
    return x.groupBy("subject", "predicate", "scope").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("citations"), members.alias("members"), F.count_if(F.col("status") == "stale").alias("stale"))


def untraced(summaries: DataFrame, claims: DataFrame) -> DataFrame:
    """Retired claims that no summary lists: the traceability check of a compaction."""
    listed = summaries.select(F.explode(F.split("members", ",")).alias("m")).select(F.col("m").cast("long").alias("m"))
    retired = claims.filter(F.col("status").isin("stale", "superseded", "conflicted") & ~F.col("pinned"))
    return retired.join(listed, F.col("id") == F.col("m"), "left_anti").select("id")


def scope_merge(rows: DataFrame, canonical: Column) -> DataFrame:
    """Scope variants under one canonical name; on a collision of keys the higher (confidence, id) stays."""
    return rows.withColumn("scope", canonical).groupBy("scope", "subject", "predicate").agg(F.max_by("id", F.struct("confidence", "id")).alias("id"), F.count(F.lit(1)).alias("merged"))


def drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """What two stores of the same ids lack of each other: one full join, both anti-joins at once."""
    a, b = left.select(F.col("id").alias("a")), right.select(F.col("id").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("orphans"), F.abs(F.count("a") - F.count("b")).alias("drift"))


def shadow_admission(rows: DataFrame, budget: int, order: list) -> DataFrame:
    """Duplicates and weak rows marked first, then admission in order under a token budget; one running sum a scope."""
    first = F.row_number().over(W.partitionBy("scope", "key").orderBy(*order)) == 1
    x = rows.withColumn("reason", F.when(~first, "duplicate").when(F.col("support") < 0.2, "weak_support"))
    running = F.sum(F.when(F.col("reason").isNull(), F.col("tokens")).otherwise(0)).over(W.partitionBy("scope").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("decision", F.coalesce("reason", F.when(running <= budget, "admit").otherwise("over_budget"))).drop("reason")


def payload_errors(ledger: DataFrame) -> DataFrame:
    """Event payloads without the keys their type requires."""
    parsed = F.from_json("payload", "k int")
    return ledger.filter(parsed.isNull() | F.from_json("payload", "k int").getField("k").isNull() | (F.col("event_type") == "decay") & (parsed.getField("k") > 90))


def rule_of(text: Column) -> Column:
    """trigger, action and rationale of a rule stored as JSON; null where it doesn't parse or lacks an action."""
    r = F.from_json(text, "trigger string, action string, rationale string")
    return F.when(r.getField("action").isNotNull(), r)
