"""Scans, visibility, time, joins and integrity checks over claims. Pure DataFrame functions; ``now`` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

LISTED = ("pinned", "confidence", "updated_at", "id")

#: Lifecycle: the states that each state may move to.
LIFECYCLE = {
    "candidate": ("confirmed", "conflicted", "superseded", "archived"),
    "confirmed": ("stale", "superseded", "conflicted", "archived"),
    "stale": ("confirmed", "superseded", "conflicted", "archived"),
    "superseded": ("archived",),
    "conflicted": ("confirmed", "superseded", "stale", "archived"),
    "archived": (),
}
TRUSTED, EXPLORATORY = ("confirmed",), ("confirmed", "stale", "conflicted", "candidate")


def list_claims(claims: DataFrame, limit: int | None = None, ids: list | None = None, statuses: tuple | None = None, scopes: list | None = None, include_archived: bool = False) -> DataFrame:
    """AND of the filters; archived ones only when asked for; ids=[] is empty, None unfiltered; pinned, confident and recent first."""
    x = claims
    if ids is not None:
        x = x.filter(F.col("id").isin(ids)) if ids else x.limit(0)
    if statuses is not None:
        x = x.filter(F.col("status").isin(*statuses))
    elif not include_archived:
        x = x.filter("status <> 'archived'")
    if scopes is not None:
        x = x.filter(F.col("scope").isin(scopes))
    x = x.orderBy(*[F.col(c).desc() for c in LISTED])
    return x.limit(limit) if limit else x


def keyset_page(claims: DataFrame, after: tuple, limit: int) -> DataFrame:
    """The page after a row in the listing order: a row-value comparison, written out."""
    reach: Column = F.lit(False)
    equal: Column = F.lit(True)
    for name, value in zip(LISTED, after, strict=True):
        reach = reach | (equal & (F.col(name) < value))
        equal = equal & (F.col(name) == value)
    return list_claims(claims.filter(reach), limit)


def resolve(claims: DataFrame, key: Column) -> DataFrame:
    """Point lookup by an identity; an ambiguous identity is an error when the row is read."""
    x = claims.filter(key)
    return x.withColumn("id", F.when(F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) > 1, F.raise_error(F.lit("ambiguous identity"))).otherwise(F.col("id")))


def due_for_decay(claims: DataFrame, limit: int) -> DataFrame:
    return claims.filter("status = 'confirmed' AND NOT pinned").orderBy("updated_at", "id").limit(limit)


def due_for_compaction(claims: DataFrame, now: Column, retain_days: int, limit: int) -> DataFrame:
    cutoff = now - F.make_dt_interval(F.lit(retain_days))
    return claims.filter(F.col("status").isin("stale", "superseded", "conflicted") & ~F.col("pinned") & (F.col("updated_at") < cutoff)).orderBy("updated_at", "id").limit(limit)


def current(claims: DataFrame, now: Column) -> DataFrame:
    """Valid at ``now``: from inclusive, until exclusive; open bounds hold."""
    return claims.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= now)) & (F.col("valid_until").isNull() | (F.col("valid_until") > now)))


def as_of(claims: DataFrame, at: Column, limit: int | None = None) -> DataFrame:
    x = current(claims.filter("status <> 'archived'"), at).orderBy(F.desc("updated_at"), F.desc("id"))
    return x.limit(limit) if limit else x


def visible(rows: DataFrame, agent: str | None) -> DataFrame:
    """Public rows and the agent's own; without an agent all rows."""
    return rows if agent is None else rows.filter((F.col("visibility") == "public") | (F.col("source_agent") == agent))


def federated(rows: DataFrame, scope: str, allow: tuple = ()) -> DataFrame:
    """Rows another scope may read: sensitive only in the own scope; ``team:`` scopes only when allowed or own."""
    own = F.col("scope") == scope
    team = F.col("scope").startswith("team:")
    return rows.filter((own | (F.col("visibility") != "sensitive")) & (~team | own | F.col("scope").isin(*allow) if allow else ~team | own))


def scope_covers(scope: str, column: Column) -> Column:
    """A root scope covers its children (project -> project:x)."""
    return (column == scope) | (F.lit(scope == "project") & column.startswith("project:"))


def with_citations(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Each claim with its citation count and sources; counted before the join, so that nothing fans out."""
    c = citations.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_citations"), F.min("source").alias("first_source"), F.countDistinct("source").alias("n_sources"))
    return claims.join(c, claims.id == c.claim_id, "left").drop("claim_id").withColumns({"n_citations": F.coalesce("n_citations", F.lit(0)), "n_sources": F.coalesce("n_sources", F.lit(0))})


def confirmed_rivals(claims: DataFrame) -> DataFrame:
    """(id, rival): claims with a confirmed one of the same subject, predicate and scope."""
    a, b = claims.alias("a"), claims.filter("status = 'confirmed'").alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("subject", "predicate", "scope")]
    on = same[0] & same[1] & same[2] & (F.col("a.id") != F.col("b.id"))
    return a.join(b, on).select(F.col("a.id").alias("id"), F.col("b.id").alias("rival_id"), F.col("b.confidence").alias("rival_confidence"))


def orphans(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Claims without a citation, citations without a claim, and replacements that don't exist."""
    bare = claims.join(citations, claims.id == citations.claim_id, "left_anti").select("id", F.lit("no_citation").alias("problem"))
    lost = citations.join(claims, citations.claim_id == claims.id, "left_anti").select(F.col("claim_id").alias("id"), F.lit("no_claim").alias("problem")).distinct()
    ids = claims.select(F.col("id").alias("target"))
    dangling = claims.filter("replaced_by IS NOT NULL").join(ids, F.col("replaced_by") == F.col("target"), "left_anti").select("id", F.lit("dangling_replacement").alias("problem"))
    return bare.unionByName(lost).unionByName(dangling)


def clean_evidence(claims: DataFrame, citations: DataFrame, clean: Column, dirty: Column) -> DataFrame:
    """EXISTS clean AND NOT EXISTS dirty evidence, in one aggregate."""
    good = citations.groupBy("claim_id").agg(F.bool_or(clean).alias("has"), F.bool_or(dirty).alias("bad")).filter("has AND NOT bad")
    return claims.join(good, claims.id == good.claim_id, "left_semi")


def support_star(claims: DataFrame, citations: DataFrame, suppliers: DataFrame, nations: DataFrame, parts: DataFrame) -> DataFrame:
    """Claim, evidence, source and dimensions in one star; Spark broadcasts the small dimensions."""
    x = citations.join(claims, citations.claim_id == claims.id).join(suppliers, F.col("source") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey")).join(parts, F.col("part") == F.col("p_partkey"))
    return x.filter("status = 'confirmed'").groupBy("n_name").agg(F.count(F.lit(1)).alias("supports"), F.countDistinct("id").alias("claims"), F.countDistinct("source").alias("sources"))


def alias_fanout(claims: DataFrame, each: int) -> DataFrame:
    """Newest ``each`` claims of every subject."""
    w = W.partitionBy("subject").orderBy(F.desc("updated_at"), F.desc("id"))
    return claims.filter("status <> 'archived'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= each)


def neighbours(links: DataFrame, seeds: Column, cap: int) -> DataFrame:
    """Two passes: seeds -> their entities -> other claims, by shared entities, at most ``cap``."""
    entities = links.filter(seeds).select(F.col("source").alias("e")).distinct()
    near = links.filter(~seeds).join(entities, F.col("source") == F.col("e")).groupBy("claim_id").agg(F.countDistinct("source").alias("shared"))
    return near.orderBy(F.desc("shared"), "claim_id").limit(cap)


def preceding(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Each user turn with the last turn of ``role`` before it in its session."""
    w = W.partitionBy("session_id").orderBy("id").rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("before_id", F.last(F.when(F.col("role") == role, F.col("id")), ignorenulls=True).over(w)).filter("role = 'user'")


def overlaps(claims: DataFrame, intervals: DataFrame) -> DataFrame:
    """Claims whose validity meets an interval (closed on both ends); few intervals, hence a broadcast range join."""
    until = F.coalesce(F.col("valid_until"), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
    return claims.join(F.broadcast(intervals), (F.col("valid_from") <= F.col("q_to")) & (until >= F.col("q_from")))


def merge_winners(mine: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """Merge by key: insert what only they have, keep what only I have, else the higher (confidence, updated_at, id)."""
    m, t = mine.alias("m"), theirs.alias("t")
    order = lambda s: F.struct(F.col(f"{s}.confidence"), F.col(f"{s}.updated_at"), F.col(f"{s}.id"))
    on = [F.col(f"m.{k}") == F.col(f"t.{k}") for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    x = m.join(t, cond, "full_outer")
    takes = F.col("m.id").isNull() | (F.col("t.id").isNotNull() & (order("t") > order("m")))
    action = F.when(F.col("m.id").isNull(), "insert").when(F.col("t.id").isNull(), "keep").when(takes, "update").otherwise("keep_newer")
    return x.select(*[F.coalesce(f"m.{k}", f"t.{k}").alias(k) for k in key], F.when(takes, F.col("t.id")).otherwise(F.col("m.id")).alias("winner_id"), action.alias("action"))


def snapshot_diff(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """added, removed and changed rows by id, with the names of the fields that differ."""
    o, n = old.select("id", *fields).alias("o"), new.select("id", *fields).alias("n")
    changed = F.filter(F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    x = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").withColumn("_c", changed)
    kind = F.when(F.col("o.id").isNull(), "added").when(F.col("n.id").isNull(), "removed").when(F.size("_c") > 0, "changed")
    return x.withColumn("change", kind).filter("change IS NOT NULL").select(F.coalesce("o.id", "n.id").alias("id"), "change", F.when(F.col("change") == "changed", F.array_join("_c", ",")).otherwise("").alias("fields"))


def delta(claims: DataFrame, citations: DataFrame, since: Column) -> DataFrame:
    """Claims updated at or after ``since`` (the boundary is sent again) with the number of their citations."""
    new = claims.filter(F.col("updated_at") >= since)
    return with_citations(new, citations.join(new, citations.claim_id == new.id, "left_semi"))


def illegal_transitions(ledger: DataFrame) -> DataFrame:
    """Transitions outside the lifecycle, against a small broadcast table of allowed pairs."""
    pairs = ledger.sparkSession.createDataFrame([(a, b) for a, to in LIFECYCLE.items() for b in to], "a string, b string")
    return ledger.join(F.broadcast(pairs), (F.col("from_status") == F.col("a")) & (F.col("to_status") == F.col("b")), "left_anti")


def chain_hashes(ledger: DataFrame, fields: list[str], key: list[str]) -> DataFrame:
    """Per row: its content hash and the previous one's in the chain; verification needs only a lag, not a replay."""
    w = W.partitionBy(*key).orderBy("id")
    x = ledger.withColumn("content_hash", F.sha2(F.concat_ws("|", *[F.col(f).cast("string") for f in fields]).cast("binary"), 256))
    x = x.withColumn("prev_hash", F.coalesce(F.lag("content_hash").over(w), F.lit("genesis")))
    return x.withColumn("event_hash", F.sha2(F.concat_ws("|", "prev_hash", "content_hash").cast("binary"), 256))


def broken_links(stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a stored chain whose recorded previous hash or own hash doesn't hold."""
    w = W.partitionBy(*key).orderBy("id")
    again = F.sha2(F.concat_ws("|", "prev_hash", "content_hash").cast("binary"), 256)
    x = stored.withColumn("_prev", F.coalesce(F.lag("content_hash").over(w), F.lit("genesis")))
    return x.filter((F.col("_prev") != F.col("prev_hash")) | (again != F.col("event_hash"))).drop("_prev")


def pending(ledger: DataFrame, proposed: Column, settled: Column) -> DataFrame:
    """Proposals without a later settlement of the same claim."""
    p, s = ledger.filter(proposed).alias("p"), ledger.filter(settled).select(F.col("claim_id").alias("c"), F.col("id").alias("s_id"))
    return p.join(s, (F.col("claim_id") == F.col("c")) & (F.col("s_id") > F.col("p.id")), "left_anti")
