"""Queries over claims, citations and the event ledger."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from claimforge.operators import claims as C, evaluate as E, governance as G, graph as X, search as S
from claimforge.plans.base import CITATIONS, CLAIMS, LEDGER, NOW, TURNS, hours, query
from claimforge.sources import adapters as A


def AT():
    return A.now(A.NOW_CLAIMS)



@query("s1_list_claims_ordered", "SELECT id, status, scope, pinned, confidence, updated_at FROM claims WHERE status <> 'archived' AND scope IN (1, 3) ORDER BY pinned DESC, confidence DESC, updated_at DESC, id DESC LIMIT 500", CLAIMS)
def s1(spark, d):
    return C.list_claims(A.claims(spark, d), 500, scopes=[1, 3]).select("id", "status", "scope", "pinned", "confidence", "updated_at")


@query("s2_keyset_page", "SELECT id, confidence, updated_at FROM claims WHERE status <> 'archived' AND (pinned, confidence, updated_at, id) < (false, 0.5::DOUBLE, TIMESTAMP '1999-01-01', 1000000) ORDER BY pinned DESC, confidence DESC, updated_at DESC, id DESC LIMIT 200", CLAIMS)
def s2(spark, d):
    return C.keyset_page(A.claims(spark, d), (F.lit(False), F.lit(0.5), A.now("1999-01-01 00:00:00"), F.lit(1000000)), 200).select("id", "confidence", "updated_at")


@query("s3_resolve_claim", "SELECT id, status, subject FROM claims WHERE id = 77", CLAIMS)
def s3(spark, d):
    return C.resolve(A.claims(spark, d), F.col("id") == 77).select("id", "status", "subject")


@query("s4_event_scan", "SELECT id, claim_id, event_type, created_at FROM ledger WHERE event_type = 'validator' AND created_at >= TIMESTAMP '2024-01-15' ORDER BY created_at DESC, id DESC LIMIT 300", LEDGER)
def s4(spark, d):
    x = A.ledger(spark, d).filter((F.col("event_type") == "validator") & (F.col("created_at") >= A.now("2024-01-15 00:00:00")))
    return x.orderBy(F.desc("created_at"), F.desc("id")).limit(300).select("id", "claim_id", "event_type", "created_at")


@query("s5_due_for_decay", "SELECT id, updated_at FROM claims WHERE status = 'confirmed' AND NOT pinned ORDER BY updated_at, id LIMIT 400", CLAIMS)
def s5a(spark, d):
    return C.due_for_decay(A.claims(spark, d), 400).select("id", "updated_at")


@query("s5_due_for_compaction", f"SELECT id, status, updated_at FROM claims WHERE status IN ('stale','superseded','conflicted') AND NOT pinned AND updated_at < {NOW} - INTERVAL 365 DAY ORDER BY updated_at, id LIMIT 400", CLAIMS)
def s5b(spark, d):
    return C.due_for_compaction(A.claims(spark, d), AT(), 365, 400).select("id", "status", "updated_at")


@query("p1_trust_plan", "SELECT status, count(*) AS n, count(*) FILTER (status = 'confirmed') AS trusted FROM claims WHERE status IN ('confirmed','stale','conflicted','candidate') GROUP BY status", CLAIMS)
def p1(spark, d):
    x = A.claims(spark, d).filter(F.col("status").isin(*C.EXPLORATORY))
    return x.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*C.TRUSTED)).alias("trusted"))


@query("p3_current_claims", f"SELECT id, valid_from, valid_until FROM claims WHERE (valid_from IS NULL OR valid_from <= {NOW}) AND (valid_until IS NULL OR valid_until > {NOW})", CLAIMS)
def p3(spark, d):
    return C.current(A.claims(spark, d), AT()).select("id", "valid_from", "valid_until")


@query("p7_tenant_scope", "SELECT scope, count(*) AS n FROM claims WHERE source_agent IS NOT DISTINCT FROM '3' GROUP BY scope", CLAIMS)
def p7(spark, d):
    return A.claims(spark, d).filter(F.col("source_agent").eqNullSafe("3")).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("p12_as_of_snapshot", "SELECT id, status, updated_at FROM claims WHERE status <> 'archived' AND valid_from <= TIMESTAMP '1998-06-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1998-06-01') ORDER BY updated_at DESC, id DESC LIMIT 1000", CLAIMS)
def p12(spark, d):
    return C.as_of(A.claims(spark, d), A.now("1998-06-01 00:00:00"), 1000).select("id", "status", "updated_at")


@query("p10_batch_cap", "SELECT id, claim_id FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, date_trunc('day', created_at) ORDER BY created_at, id) AS r FROM ledger) WHERE r <= 2", LEDGER)
def p10a(spark, d):
    w = W.partitionBy("claim_id", F.date_trunc("day", "created_at")).orderBy("created_at", "id")
    return A.ledger(spark, d).withColumn("r", F.row_number().over(w)).filter("r <= 2").select("id", "claim_id")


@query("p10_window_quota", "SELECT claim_id, date_trunc('hour', created_at) AS win, count(*) AS used, count(*) > 1 AS over_quota FROM ledger GROUP BY 1, 2", LEDGER)
def p10b(spark, d):
    x = A.ledger(spark, d).groupBy("claim_id", F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("win")).agg(F.count(F.lit(1)).alias("used"))
    return x.withColumn("over_quota", F.col("used") > 1)


@query("p16_pending_minus_resolved", "SELECT id, claim_id FROM ledger p WHERE event_type = 'supersession' AND NOT EXISTS (SELECT 1 FROM ledger s WHERE s.event_type = 'validator' AND s.claim_id = p.claim_id AND s.id > p.id)", LEDGER)
def p16(spark, d):
    return C.pending(A.ledger(spark, d), F.col("event_type") == "supersession", F.col("event_type") == "validator").select("id", "claim_id")


@query("p17_namespaces", "SELECT CASE WHEN predicate LIKE '1%' OR predicate LIKE '2%' THEN 'decisions' WHEN predicate LIKE '3%' THEN 'workflows' ELSE 'facts' END AS namespace, count(*) AS n FROM claims GROUP BY 1", CLAIMS)
def p17(spark, d):
    p = F.col("predicate")
    return A.claims(spark, d).groupBy(F.when(p.startswith("1") | p.startswith("2"), "decisions").when(p.startswith("3"), "workflows").otherwise("facts").alias("namespace")).agg(F.count(F.lit(1)).alias("n"))


@query("j2_claims_with_citations", "SELECT id, count(source) AS n_citations, min(source) AS first_source, count(DISTINCT source) AS n_sources FROM claims LEFT JOIN citations ON id = claim_id GROUP BY id", CLAIMS, CITATIONS)
def j2(spark, d):
    return C.with_citations(A.claims(spark, d), A.citations(spark, d)).select("id", "n_citations", "first_source", "n_sources")


@query("j3_confirmed_rivals", "SELECT a.id, b.id AS rival_id, b.confidence AS rival_confidence FROM claims a JOIN claims b ON a.subject = b.subject AND a.predicate = b.predicate AND a.scope = b.scope AND a.id <> b.id WHERE b.status = 'confirmed'", CLAIMS)
def j3(spark, d):
    return C.confirmed_rivals(A.claims(spark, d))


@query("j7_orphans", """SELECT id, 'no_citation' AS problem FROM claims WHERE id NOT IN (SELECT claim_id FROM citations)
 UNION ALL SELECT DISTINCT claim_id, 'no_claim' FROM citations WHERE claim_id NOT IN (SELECT id FROM claims)
 UNION ALL SELECT id, 'dangling_replacement' FROM claims WHERE replaced_by IS NOT NULL AND replaced_by NOT IN (SELECT id FROM claims)""", CLAIMS, CITATIONS)
def j7(spark, d):
    return C.orphans(A.claims(spark, d), A.citations(spark, d))


@query("j9_clean_evidence_claims", "SELECT id, status FROM claims c WHERE EXISTS (SELECT 1 FROM citations WHERE claim_id = c.id AND source % 3 = 0) AND NOT EXISTS (SELECT 1 FROM citations WHERE claim_id = c.id AND source % 7 = 0)", CLAIMS, CITATIONS)
def j9(spark, d):
    return C.clean_evidence(A.claims(spark, d), A.citations(spark, d), F.col("source") % 3 == 0, F.col("source") % 7 == 0).select("id", "status")


@query("j10_support_star", "SELECT n_name, count(*) AS supports, count(DISTINCT id) AS claims, count(DISTINCT source) AS sources FROM citations JOIN claims ON claim_id = id JOIN supplier ON source = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON part = p_partkey WHERE status = 'confirmed' GROUP BY n_name", CLAIMS, CITATIONS)
def j10(spark, d):
    return C.support_star(A.claims(spark, d), A.citations(spark, d), A.read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), A.read(spark, d, "nation").select("n_nationkey", "n_name"), A.read(spark, d, "part").select("p_partkey"))


@query("j11_alias_fanout_top3", "SELECT subject, id, rank FROM (SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY updated_at DESC, id DESC) AS rank FROM claims WHERE status <> 'archived') WHERE rank <= 3", CLAIMS)
def j11(spark, d):
    return C.alias_fanout(A.claims(spark, d), 3).select("subject", "id", "rank")


@query("j12_two_pass_neighbours", "SELECT claim_id, count(DISTINCT source) AS shared FROM citations WHERE claim_id >= 5 AND source IN (SELECT source FROM citations WHERE claim_id < 5) GROUP BY claim_id ORDER BY shared DESC, claim_id LIMIT 20", CITATIONS)
def j12(spark, d):
    return C.neighbours(A.citations(spark, d), F.col("claim_id") < 5, 20)


@query("j13_preceding_assistant", "SELECT u.id, u.session_id, (SELECT max(a.id) FROM turns a WHERE a.session_id = u.session_id AND a.role = 'assistant' AND a.id < u.id) AS before_id FROM turns u WHERE role = 'user'", TURNS)
def j13(spark, d):
    return C.preceding(A.turns(spark, d)).select("id", "session_id", "before_id")


INTERVALS = [(1, "1996-01-01 00:00:00", "1996-01-31 00:00:00"), (2, "1998-05-01 00:00:00", "1998-05-02 00:00:00"), (3, "2001-01-01 00:00:00", "2001-12-31 00:00:00")]


@query("j14_interval_overlap", """WITH q AS (SELECT * FROM (VALUES (1, TIMESTAMP '1996-01-01', TIMESTAMP '1996-01-31'), (2, TIMESTAMP '1998-05-01', TIMESTAMP '1998-05-02'), (3, TIMESTAMP '2001-01-01', TIMESTAMP '2001-12-31')) t(q_id, q_from, q_to))
 SELECT q_id, status, count(*) AS n FROM claims JOIN q ON valid_from <= q_to AND coalesce(valid_until, TIMESTAMP '9999-12-31') >= q_from GROUP BY q_id, status""", CLAIMS)
def j14(spark, d):
    q = spark.createDataFrame(INTERVALS, "q_id int, f string, t string").select("q_id", F.col("f").cast("timestamp_ntz").alias("q_from"), F.col("t").cast("timestamp_ntz").alias("q_to"))
    return C.overlaps(A.claims(spark, d), q).groupBy("q_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("j15_conflict_payload", "WITH k AS (SELECT DISTINCT subject, predicate, scope FROM claims WHERE status = 'conflicted') SELECT c.subject, c.predicate, c.scope, count(*) AS n, max(c.updated_at) AS newest FROM claims c JOIN k USING (subject, predicate, scope) WHERE c.status <> 'archived' GROUP BY ALL", CLAIMS)
def j15(spark, d):
    c, key = A.claims(spark, d), ["subject", "predicate", "scope"]
    return c.filter("status <> 'archived'").join(c.filter("status = 'conflicted'").select(*key), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("newest"))


@query("j16_merge_winners", """WITH m AS (SELECT subject, predicate, max(struct_pack(confidence, updated_at, id)) AS x FROM claims WHERE id % 2 = 0 GROUP BY 1, 2), t AS (SELECT subject, predicate, max(struct_pack(confidence, updated_at, id)) AS x FROM claims WHERE id % 2 = 1 GROUP BY 1, 2)
 SELECT coalesce(m.subject, t.subject) AS subject, coalesce(m.predicate, t.predicate) AS predicate, CASE WHEN m.x IS NULL OR (t.x IS NOT NULL AND t.x > m.x) THEN t.x.id ELSE m.x.id END AS winner_id,
 CASE WHEN m.x IS NULL THEN 'insert' WHEN t.x IS NULL THEN 'keep' WHEN t.x > m.x THEN 'update' ELSE 'keep_newer' END AS action FROM m FULL JOIN t ON m.subject = t.subject AND m.predicate = t.predicate""", CLAIMS)
def j16(spark, d):
    best = F.max(F.struct("confidence", "updated_at", "id")).alias("x")
    side = lambda odd: A.claims(spark, d).filter(F.col("id") % 2 == odd).groupBy("subject", "predicate").agg(best).select("subject", "predicate", "x.*")
    return C.merge_winners(side(0), side(1), ["subject", "predicate"])


@query("j17_snapshot_diff", """WITH o AS (SELECT id, status, confidence FROM claims WHERE id % 10 <> 3), n AS (SELECT id, CASE WHEN id % 11 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN id % 13 = 0 THEN 0.0::DOUBLE ELSE confidence END AS confidence FROM claims WHERE id % 10 <> 4)
 SELECT * FROM (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.status <> n.status OR o.confidence <> n.confidence THEN 'changed' END AS change,
 CASE WHEN o.id IS NULL OR n.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.status <> n.status THEN 'status' END, CASE WHEN o.confidence <> n.confidence THEN 'confidence' END) END AS fields FROM o FULL JOIN n ON o.id = n.id) WHERE change IS NOT NULL""", CLAIMS)
def j17(spark, d):
    c = A.claims(spark, d)
    new = c.filter("id % 10 <> 4").withColumns({"status": F.when(F.col("id") % 11 == 0, "archived").otherwise(F.col("status")), "confidence": F.when(F.col("id") % 13 == 0, 0.0).otherwise(F.col("confidence"))})
    return C.snapshot_diff(c.filter("id % 10 <> 3"), new, ["status", "confidence"])


@query("j19_latest_proposal", "SELECT claim_id, max(id) AS id FROM ledger WHERE event_type = 'supersession' GROUP BY claim_id", LEDGER)
def j19(spark, d):
    return A.ledger(spark, d).filter("event_type = 'supersession'").groupBy("claim_id").agg(F.max_by("id", "id").alias("id"))


@query("k1_delta_export", "SELECT id, count(source) AS n_citations FROM claims LEFT JOIN citations ON id = claim_id WHERE updated_at >= TIMESTAMP '2001-01-01' GROUP BY id", CLAIMS, CITATIONS)
def k1(spark, d):
    return C.delta(A.claims(spark, d), A.citations(spark, d), A.now("2001-01-01 00:00:00")).select("id", "n_citations")


@query("k2_summary_graph", "SELECT scope, predicate, count(*) AS n, count(DISTINCT status) AS n_status, min(id) AS first_id FROM claims WHERE status IN ('stale','superseded','conflicted') GROUP BY ALL", CLAIMS)
def k2(spark, d):
    return A.claims(spark, d).filter(F.col("status").isin("stale", "superseded", "conflicted")).groupBy("scope", "predicate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("status").alias("n_status"), F.min("id").alias("first_id"))


@query("k3_graph_dot", "SELECT '\"' || l_orderkey || '\" -> \"s' || l_suppkey || '\"' AS line FROM lineitem GROUP BY l_orderkey, l_suppkey")
def k3(spark, d):
    return A.citations(spark, d).select(F.format_string('"%d" -> "s%d"', "claim_id", "source").alias("line")).distinct()


@query("a1_validation_priors", "SELECT raw_type AS kind, count(*) AS attempts, count(*) FILTER (to_status = 'confirmed') AS validated, round(count(*) FILTER (to_status = 'confirmed') / count(*), 4) AS rate FROM ledger GROUP BY raw_type", LEDGER)
def a1(spark, d):
    return G.priors(A.ledger(spark, d))


@query("a2_provenance_by_agent", f"""SELECT coalesce(nullif(trim(source_agent), ''), '<null>') AS agent, count(*) AS total, count(*) FILTER (status = 'candidate') AS candidate, count(*) FILTER (status = 'confirmed') AS confirmed,
 count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'superseded') AS superseded, count(*) FILTER (status = 'conflicted') AS conflicted, max(created_at) AS last_created,
 count(*) FILTER (created_at >= {NOW} - INTERVAL 30 DAY) AS recent FROM claims WHERE status <> 'archived' GROUP BY 1""", CLAIMS)
def a2(spark, d):
    return G.provenance(A.claims(spark, d), AT())


@query("a3_validation_latency_percentiles", """WITH f AS (SELECT claim_id, min(created_at) AS seen FROM citations GROUP BY 1), x AS (SELECT greatest(0.0::DOUBLE, date_diff('second', c.created_at, seen) / 3600.0::DOUBLE) / 24.0 AS days FROM claims c JOIN f ON id = claim_id)
 SELECT count(*) AS n, round(quantile_cont(days, 0.5), 6) AS p50, round(quantile_cont(days, 0.95), 6) AS p95, round(quantile_cont(days, 0.99), 6) AS p99 FROM x""", CLAIMS, CITATIONS)
def a3(spark, d):
    return G.latency_percentiles(A.claims(spark, d), A.citations(spark, d))


@query("a4_nearest_rank_latency", "SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM ledger GROUP BY event_type", LEDGER)
def a4(spark, d):
    return G.nearest_rank(A.ledger(spark, d), "event_type", "value")


@query("a5_event_counters", "SELECT event_type, to_status, count(*) AS n, count(*) FILTER (json_extract(payload, '$.k') IS NULL) AS invalid FROM ledger GROUP BY 1, 2", LEDGER)
def a5(spark, d):
    return A.ledger(spark, d).groupBy("event_type", "to_status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("payload", "$.k").isNull()).alias("invalid"))


@query("a6_quality_scores", f"""WITH r AS (SELECT claim_id, count(*) AS n FROM ledger WHERE event_type = 'validator' GROUP BY 1), x AS (SELECT c.*, coalesce(n, 0) AS n, floor({hours('created_at')} / 24.0) AS age FROM claims c LEFT JOIN r ON id = claim_id)
 SELECT id, n AS retrievals, round(greatest(0.0, least(1.0, 0.5::DOUBLE + least(n * 0.05::DOUBLE, 0.3) + least(access_count * 0.03::DOUBLE, 0.2) + CASE WHEN access_count > 0 AND age < 7 THEN 0.1 ELSE 0.0 END - CASE WHEN access_count = 0 AND n = 0 AND age > 30 THEN 0.1 ELSE 0.0 END)), 6) AS quality FROM x""", CLAIMS, LEDGER)
def a6(spark, d):
    return G.quality_scores(A.claims(spark, d), A.ledger(spark, d).filter("event_type = 'validator'"), AT())


@query("a7_session_stats", "SELECT session_id, count(*) AS n, sum(length(content))::BIGINT AS chars FROM turns GROUP BY session_id", TURNS)
def a7(spark, d):
    return A.turns(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("a8_entity_counts", "SELECT source, count(DISTINCT part) AS aliases, count(DISTINCT claim_id) AS claims FROM citations GROUP BY source", CITATIONS)
def a8(spark, d):
    return A.citations(spark, d).groupBy("source").agg(F.countDistinct("part").alias("aliases"), F.countDistinct("claim_id").alias("claims"))


@query("a10_verbatim_composition", "WITH g AS (SELECT source, text, count(*) AS c FROM documents GROUP BY 1, 2) SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(DISTINCT text) FROM documents) AS distinct_content, coalesce(sum(c - 1) FILTER (c > 1), 0)::BIGINT AS duplicates FROM g")
def a10(spark, d):
    docs = A.read(spark, d, "documents").select("source", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    dup = docs.groupBy("source", "h", "n").agg(F.count(F.lit(1)).alias("c"))
    by_text = dup.groupBy("h", "n").agg(F.sum("c").alias("t"), F.sum(F.col("c") - 1).alias("d"))
    return by_text.agg(F.sum("t").alias("total"), F.count(F.lit(1)).alias("distinct_content"), F.sum("d").alias("duplicates"))


@query("a11_thin_observations", "SELECT source, count(DISTINCT claim_id) AS claims, count(DISTINCT part) AS parts FROM citations GROUP BY source HAVING count(DISTINCT claim_id) < 600 OR count(DISTINCT part) < 500", CITATIONS)
def a11(spark, d):
    return A.citations(spark, d).groupBy("source").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("part").alias("parts")).filter("claims < 600 OR parts < 500")


@query("a12_job_status", "SELECT event_type, count(*) FILTER (to_status = 'confirmed') AS confirmed, count(*) FILTER (to_status = 'stale') AS stale, count(*) FILTER (to_status = 'archived') AS archived FROM ledger GROUP BY 1", LEDGER)
def a12(spark, d):
    return A.ledger(spark, d).groupBy("event_type").pivot("to_status", ["confirmed", "stale", "archived"]).count().fillna(0)


@query("a13_coverage_gaps", "SELECT scope, count(*) AS confirmed, count(*) FILTER (id NOT IN (SELECT claim_id FROM ledger)) AS missing FROM claims WHERE status = 'confirmed' GROUP BY scope", CLAIMS, LEDGER)
def a13(spark, d):
    return G.coverage_gaps(A.claims(spark, d), A.ledger(spark, d))


@query("a14_conflict_groups", "SELECT subject, predicate, scope, count(*) AS n, count(DISTINCT lower(trim(object_value))) AS n_values FROM claims GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT lower(trim(object_value))) > 1", CLAIMS)
def a14(spark, d):
    return G.conflict_groups(A.claims(spark, d))


@query("a16_durative_states", "SELECT subject, predicate, min(valid_from) AS valid_from, CASE WHEN count(valid_until) = count(*) THEN max(valid_until) END AS valid_until, count(*) AS n FROM claims GROUP BY subject, predicate", CLAIMS)
def a16(spark, d):
    return G.durative_states(A.claims(spark, d))


@query("a17_episodes", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS r FROM turns) SELECT session_id, count(*) AS n, count(DISTINCT role) > 1 AS recurring, substr(sha256(string_agg(id::VARCHAR, ',' ORDER BY id)), 1, 16) AS episode_id FROM x WHERE r <= 4 GROUP BY session_id", TURNS)
def a17(spark, d):
    return G.episodes(A.turns(spark, d), 4)


@query("a18_daily_note", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM ledger WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-11' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10", LEDGER)
def a18(spark, d):
    x = A.ledger(spark, d).filter((F.col("created_at") >= A.now("2024-01-10 00:00:00")) & (F.col("created_at") < A.now("2024-01-11 00:00:00")))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")).orderBy(F.desc("n"), "event_type").limit(10)


@query("a20_rule_tally", "SELECT subject, count(*) AS n, round(0.4 + 0.3 * least(count(*) / 3.0::DOUBLE, 1.0), 6) AS confidence, substr(sha256(lower(subject::VARCHAR || '|' || 'rule')), 1, 16) AS fingerprint FROM claims WHERE status = 'candidate' GROUP BY subject", CLAIMS)
def a20(spark, d):
    x = A.claims(spark, d).filter("status = 'candidate'").groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return x.select("subject", "n", F.round(G.tally_confidence(F.col("n")), 6).alias("confidence"), F.substring(F.sha2(F.lower(F.concat(F.col("subject").cast("string"), F.lit("|rule"))).cast("binary"), 256), 1, 16).alias("fingerprint"))


@query("a21_fact_support", "SELECT part, count(DISTINCT claim_id) AS sessions, max(created_at) AS last_supported FROM citations GROUP BY part HAVING count(DISTINCT claim_id) >= 2", CITATIONS)
def a21(spark, d):
    return A.citations(spark, d).groupBy("part").agg(F.countDistinct("claim_id").alias("sessions"), F.max("created_at").alias("last_supported")).filter("sessions >= 2")


@query("a23_running_quota", "SELECT id, claim_id, round(sum(value) OVER (PARTITION BY claim_id, date_trunc('day', created_at) ORDER BY created_at, id ROWS UNBOUNDED PRECEDING), 4) AS used FROM ledger", LEDGER)
def a23(spark, d):
    w = W.partitionBy("claim_id", F.date_trunc("day", "created_at")).orderBy("created_at", "id").rowsBetween(W.unboundedPreceding, 0)
    return A.ledger(spark, d).select("id", "claim_id", F.round(F.sum("value").over(w), 4).alias("used"))


@query("a24_status_delta", "WITH a AS (SELECT from_status AS status, count(*) AS n_before FROM ledger GROUP BY 1), b AS (SELECT to_status AS status, count(*) AS n_after FROM ledger WHERE event_type <> 'decay' GROUP BY 1) SELECT coalesce(a.status, b.status) AS status, coalesce(n_before, 0) AS n_before, coalesce(n_after, 0) AS n_after, coalesce(n_after, 0) - coalesce(n_before, 0) AS change FROM a FULL JOIN b ON a.status = b.status", LEDGER)
def a24(spark, d):
    x = A.ledger(spark, d)
    return G.status_delta(x.select(F.col("from_status").alias("status")), x.filter("event_type <> 'decay'").select(F.col("to_status").alias("status")))


@query("a25_metric_unpivot", "SELECT metric, count(v) AS n, round(avg(v), 4) AS mean, max(v) AS most, round(quantile_cont(v, 0.5), 6) AS p50 FROM (SELECT unnest(['price', 'discount', 'tax']) AS metric, unnest([l_extendedprice, l_discount, l_tax]) AS v FROM lineitem) GROUP BY metric")
def a25(spark, d):
    x = A.read(spark, d, "lineitem").select(F.expr("stack(3, 'price', l_extendedprice, 'discount', l_discount, 'tax', l_tax) AS (metric, v)"))
    return x.groupBy("metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.max("v").alias("most"), F.round(F.percentile("v", F.lit(0.5)), 6).alias("p50"))


@query("a27_freshness_buckets", f"SELECT CASE WHEN exp(-{hours('updated_at')} / 24.0 / 30.0) >= 0.5 THEN 'fresh' WHEN exp(-{hours('updated_at')} / 24.0 / 30.0) >= 0.2 THEN 'mid' ELSE 'stale' END AS bucket, count(*) AS n FROM claims GROUP BY 1", CLAIMS)
def a27(spark, d):
    return A.claims(spark, d).groupBy(G.freshness_bucket(G.article_freshness(F.col("updated_at"), AT())).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("f38_article_freshness", f"SELECT id, round(exp(-{hours('updated_at')} / 24.0 / 30.0), 6) AS score, exp(-{hours('updated_at')} / 24.0 / 30.0) < 0.2 AS stale FROM claims", CLAIMS)
def f38(spark, d):
    score = G.article_freshness(F.col("updated_at"), AT())
    return A.claims(spark, d).select("id", F.round(score, 6).alias("score"), (score < G.ARTICLE_STALE).alias("stale"))


@query("a28_health_rollup", "SELECT count(*) FILTER (event_type = 'decay') AS errors, count(*) FILTER (created_at >= TIMESTAMP '2024-01-29') AS last_day, CASE WHEN count(*) FILTER (event_type = 'decay') > 100 THEN 'alert' ELSE 'ok' END AS state FROM ledger", LEDGER)
def a28(spark, d):
    x = A.ledger(spark, d).agg(F.count_if(F.col("event_type") == "decay").alias("errors"), F.count_if(F.col("created_at") >= A.now("2024-01-29 00:00:00")).alias("last_day"))
    return x.withColumn("state", F.when(F.col("errors") > 100, "alert").otherwise("ok"))


@query("a29_backlog_plan", "SELECT scope, count(*) AS n, ceil(count(*) / 50.0)::BIGINT AS batches, ceil(count(*) / 200.0)::BIGINT AS days FROM claims WHERE status = 'candidate' GROUP BY scope", CLAIMS)
def a29(spark, d):
    x = A.claims(spark, d).filter("status = 'candidate'").groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
    return x.select("scope", "n", F.ceil(F.col("n") / 50).alias("batches"), F.ceil(F.col("n") / 200).alias("days"))


@query("a30_scope_status_rollup", "SELECT scope, status, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM claims GROUP BY ROLLUP (scope, status)", CLAIMS)
def a30(spark, d):
    return G.scope_status_rollup(A.claims(spark, d))


@query("w9_conflict_winners", """WITH n AS (SELECT claim_id, count(*) AS cites FROM citations GROUP BY 1), x AS (SELECT c.*, coalesce(cites, 0) AS cites FROM claims c LEFT JOIN n ON id = claim_id),
 g AS (SELECT subject, predicate, scope, max(struct_pack(p := pinned, c := confidence, u := updated_at, n := cites, i := id)) AS w FROM x GROUP BY ALL HAVING count(DISTINCT lower(trim(object_value))) > 1)
 SELECT id AS loser_id, w.i AS winner_id, CASE WHEN w.p <> pinned THEN 'pinned_wins' WHEN w.c <> confidence THEN 'higher_confidence' WHEN w.u <> updated_at THEN 'more_recent' WHEN w.n <> cites THEN 'more_citations' ELSE 'higher_id_tiebreaker' END AS reason FROM x JOIN g USING (subject, predicate, scope) WHERE id <> w.i""", CLAIMS, CITATIONS)
def w9(spark, d):
    return G.conflict_winners(A.claims(spark, d), A.citations(spark, d))


@query("w10_dedup_survivor", "SELECT subject, predicate, first(id ORDER BY confidence DESC, pinned DESC, updated_at DESC, id) AS survivor, count(*) AS n FROM claims GROUP BY subject, predicate HAVING count(*) > 1", CLAIMS)
def w10(spark, d):
    best = F.max_by("id", F.struct("confidence", "pinned", "updated_at", -F.col("id")))
    return A.claims(spark, d).groupBy("subject", "predicate").agg(best.alias("survivor"), F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("w11_latest_per_key", "SELECT subject, predicate, first(id ORDER BY updated_at DESC, id DESC) AS id, max(updated_at) AS updated_at FROM claims GROUP BY subject, predicate", CLAIMS)
def w11(spark, d):
    return G.latest_per_key(A.claims(spark, d))


@query("w12_review_queue", f"SELECT id, status, round(CASE status WHEN 'conflicted' THEN 0.55::DOUBLE ELSE 0.40::DOUBLE END + (1.0 - confidence) * 0.35 + 0.20 * exp(-{hours('updated_at')} / 48.0), 6) AS priority FROM claims WHERE status IN ('conflicted', 'stale')", CLAIMS)
def w12(spark, d):
    return G.review_queue(A.claims(spark, d), AT())


@query("w13_revalidation_due", f"""WITH x AS (SELECT *, greatest(1.0::DOUBLE, CASE volatility WHEN 'low' THEN 720.0::DOUBLE WHEN 'medium' THEN 168.0 ELSE 24.0 END * CASE status WHEN 'confirmed' THEN 1.0::DOUBLE WHEN 'stale' THEN 0.55 ELSE 0.35 END) AS cadence, {hours('updated_at')} AS age FROM claims WHERE status IN ('confirmed','stale','conflicted'))
 SELECT id, round(age / cadence + CASE status WHEN 'stale' THEN 0.25 WHEN 'conflicted' THEN 0.4 ELSE 0.0 END + (1.0 - confidence) * 0.2 + CASE volatility WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.1 ELSE 0.0 END, 6) AS priority FROM x WHERE age >= cadence""", CLAIMS)
def w13(spark, d):
    return G.revalidation_due(A.claims(spark, d), AT())


@query("w14_budget_prefix", "SELECT session_id, id, running FROM (SELECT session_id, id, sum(greatest(1, length(content) // 4)) OVER (PARTITION BY session_id ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM turns) WHERE running <= 200", TURNS)
def w14(spark, d):
    x = A.turns(spark, d).withColumn("t", F.greatest(F.lit(1), F.floor(F.length("content") / 4)))
    return S.budget_prefix(x, ["session_id"], ["id"], "t", 200).select("session_id", "id", "running")


@query("w15_knapsack_pack", """WITH RECURSIVE t AS (SELECT session_id, id, greatest(1, length(content) // 4) AS n, row_number() OVER (PARTITION BY session_id ORDER BY id) AS r FROM (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, text AS content FROM conversations)),
 f AS (SELECT session_id, id, r, CASE WHEN n <= 200 THEN n ELSE 0 END AS used, n <= 200 AS took FROM t WHERE r = 1 UNION ALL SELECT t.session_id, t.id, t.r, CASE WHEN f.used + t.n <= 200 THEN f.used + t.n ELSE f.used END, f.used + t.n <= 200 FROM f JOIN t ON t.session_id = f.session_id AND t.r = f.r + 1)
 SELECT session_id, id, (max(used) OVER (PARTITION BY session_id))::BIGINT AS used FROM f QUALIFY took""")
def w15(spark, d):
    x = A.turns(spark, d).withColumn("t", F.greatest(F.lit(1), F.floor(F.length("content") / 4)))
    return S.knapsack(x, ["session_id"], "id", "t", 200).select("session_id", "id", "used")


@query("w16_triage_replay", "SELECT claim_id, first(raw_type ORDER BY id DESC) AS flag FROM ledger WHERE raw_type IN ('signup', 'error') GROUP BY claim_id", LEDGER)
def w16(spark, d):
    return A.ledger(spark, d).filter(F.col("raw_type").isin("signup", "error")).groupBy("claim_id").agg(F.max_by("raw_type", "id").alias("flag"))


@query("w17_retention_plan", """WITH s AS (SELECT session_id, sum(length(content))::BIGINT AS chars, max(id) AS last FROM turns GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY last DESC) AS rank FROM s), k AS (SELECT session_id, sum(chars) OVER (ORDER BY last DESC ROWS UNBOUNDED PRECEDING) AS newer FROM r WHERE rank <= 60)
 SELECT r.session_id, chars, CASE WHEN newer IS NULL THEN 'old_session' WHEN newer > 50000 THEN 'over_budget' ELSE 'kept' END AS plan FROM r LEFT JOIN k ON r.session_id = k.session_id""", TURNS)
def w17(spark, d):
    return G.retention(A.turns(spark, d), 60, 50000)


@query("w18_hash_chain_verify", """WITH h AS (SELECT id, claim_id, sha256(concat_ws('|', id::VARCHAR, claim_id::VARCHAR, event_type, payload)) AS content_hash FROM ledger), p AS (SELECT *, coalesce(lag(content_hash) OVER (PARTITION BY claim_id ORDER BY id), 'genesis') AS prev_hash FROM h)
 SELECT claim_id, count(*) AS n, max(sha256(prev_hash || '|' || content_hash)) AS top_hash, 0::BIGINT AS broken FROM p GROUP BY claim_id""", LEDGER)
def w18(spark, d):
    x = C.chain_hashes(A.ledger(spark, d), ["id", "claim_id", "event_type", "payload"], ["claim_id"])
    w = W.partitionBy("claim_id").orderBy("id")
    ok = (F.coalesce(F.lag("content_hash").over(w), F.lit("genesis")) == F.col("prev_hash")) & (F.sha2(F.concat_ws("|", "prev_hash", "content_hash").cast("binary"), 256) == F.col("event_hash"))
    return x.withColumn("ok", ok).groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_hash").alias("top_hash"), F.count_if(~F.col("ok")).alias("broken"))


@query("w19_illegal_transitions", """SELECT id, from_status, to_status FROM ledger WHERE (from_status, to_status) NOT IN (('candidate','confirmed'),('candidate','conflicted'),('candidate','superseded'),('candidate','archived'),('confirmed','stale'),('confirmed','superseded'),('confirmed','conflicted'),('confirmed','archived'),
 ('stale','confirmed'),('stale','superseded'),('stale','conflicted'),('stale','archived'),('superseded','archived'),('conflicted','confirmed'),('conflicted','superseded'),('conflicted','stale'),('conflicted','archived'))""", LEDGER)
def w19(spark, d):
    return C.illegal_transitions(A.ledger(spark, d)).select("id", "from_status", "to_status")


@query("u4_candidate_or_due", f"SELECT id, CASE WHEN status = 'candidate' THEN 'candidate' ELSE 'due' END AS why FROM claims WHERE status = 'candidate' OR (status = 'stale' AND {hours('updated_at')} > 8760)", CLAIMS)
def u4(spark, d):
    c = A.claims(spark, d)
    a = c.filter("status = 'candidate'").select("id", F.lit("candidate").alias("why"), F.lit(1).alias("o"))
    b = c.filter((F.col("status").isin("stale", "candidate")) & (G.hours(F.col("updated_at"), AT()) > 8760)).select("id", F.lit("due").alias("why"), F.lit(2).alias("o"))
    return a.unionByName(b).groupBy("id").agg(F.min_by("why", "o").alias("why"))


@query("f4_freshness", f"SELECT id, round(exp(-{hours('updated_at')} / CASE volatility WHEN 'low' THEN 168.0::DOUBLE WHEN 'medium' THEN 72.0 ELSE 24.0 END), 6) AS freshness FROM claims", CLAIMS)
def f4(spark, d):
    return A.claims(spark, d).select("id", F.round(G.freshness(F.col("updated_at"), AT()), 6).alias("freshness"))


@query("f20_validation_score", """WITH n AS (SELECT claim_id, count(*) AS k FROM citations GROUP BY 1) SELECT id, round(greatest(0.0, least(1.0, (0.35::DOUBLE + least(coalesce(k, 0) * 0.12::DOUBLE, 0.4) + least(length(predicate) / 240.0::DOUBLE, 0.15) + 0.1) * 0.75 + confidence * 0.25)), 6) AS score FROM claims LEFT JOIN n ON id = claim_id""", CLAIMS, CITATIONS)
def f20(spark, d):
    x = C.with_citations(A.claims(spark, d), A.citations(spark, d))
    return x.select("id", F.round(G.validation_score(F.col("n_citations"), F.length("predicate"), F.lit(True), F.col("confidence")), 6).alias("score"))


@query("f32_edge_decay", "SELECT claim_id, source, round(greatest(0.01::DOUBLE, exp(-0.02 * greatest(0, date_diff('day', max(created_at), TIMESTAMP '2001-12-31')))), 6) AS weight FROM citations GROUP BY claim_id, source", CITATIONS)
def f32(spark, d):
    x = A.citations(spark, d).groupBy("claim_id", "source").agg(F.max("created_at").alias("at"))
    days = F.greatest(F.lit(0), F.datediff(F.lit("2001-12-31").cast("date"), F.col("at").cast("date")))
    return x.select("claim_id", "source", F.round(G.edge_decay(F.lit(1.0), days), 6).alias("weight"))


@query("f33_confidence_decay", f"""WITH x AS (SELECT id, status, greatest(0.0::DOUBLE, confidence - CASE volatility WHEN 'low' THEN 0.005::DOUBLE WHEN 'medium' THEN 0.02 ELSE 0.05 END * ({hours('updated_at')} / 24.0)) AS c FROM claims WHERE status = 'confirmed' AND NOT pinned AND updated_at <= {NOW})
 SELECT id, round(c, 6) AS new_confidence, CASE WHEN c < 0.35 THEN 'stale' ELSE status END AS new_status FROM x""", CLAIMS)
def f33(spark, d):
    return G.decay(A.claims(spark, d), AT()).select("id", F.round("new_confidence", 6).alias("new_confidence"), "new_status")


@query("f34_wilson", """WITH x AS (SELECT raw_type, count(*)::DOUBLE AS n, (count(*) FILTER (to_status = 'confirmed'))::DOUBLE AS k FROM ledger GROUP BY 1) SELECT raw_type, round((k/n + 1.96*1.96/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n)))/(1+1.96*1.96/n), 6) AS lo, round((k/n + 1.96*1.96/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n)))/(1+1.96*1.96/n), 6) AS hi FROM x""", LEDGER)
def f34(spark, d):
    x = A.ledger(spark, d).groupBy("raw_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("to_status") == "confirmed").alias("k"))
    lo, hi = E.wilson(F.col("k"), F.col("n"))
    return x.select("raw_type", lo.alias("lo"), hi.alias("hi"))


@query("f35_steward_features", f"""WITH n AS (SELECT claim_id, count(*) AS k, count(DISTINCT source) AS s FROM citations GROUP BY 1), p AS (SELECT subject, predicate, count(*) AS peers FROM claims GROUP BY ALL)
 SELECT id, coalesce(k, 0) AS n_citations, coalesce(s, 0) AS n_sources, peers, round({hours('created_at')} / 24.0, 4) AS age_days, pinned, access_count, volatility = 'high' AS volatile, source_agent IS NULL AS anonymous FROM claims c LEFT JOIN n ON id = claim_id JOIN p USING (subject, predicate)""", CLAIMS, CITATIONS)
def f35(spark, d):
    x = C.with_citations(A.claims(spark, d), A.citations(spark, d)).withColumn("peers", F.count(F.lit(1)).over(W.partitionBy("subject", "predicate")))
    return x.select("id", "n_citations", "n_sources", "peers", F.round(G.hours(F.col("created_at"), AT()) / 24.0, 4).alias("age_days"), "pinned", "access_count", (F.col("volatility") == "high").alias("volatile"), F.col("source_agent").isNull().alias("anonymous"))


EDGES = "edges AS (SELECT DISTINCT 'c' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem)"


def _edges(spark, d):
    return A.citations(spark, d).select(F.concat(F.lit("c"), F.col("claim_id")).alias("src"), F.concat(F.lit("s"), F.col("source")).alias("dst")).distinct()


@query("g3_min_hops", """WITH RECURSIVE b AS (SELECT DISTINCT 'c' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'c' || l_orderkey FROM lineitem),
 r AS (SELECT 'c0' AS node, 0 AS hop UNION SELECT b.dst, r.hop + 1 FROM r JOIN b ON r.node = b.src WHERE r.hop < 3) SELECT node, min(hop) AS hop FROM r GROUP BY node""")
def g3(spark, d):
    return X.hops(_edges(spark, d), spark.createDataFrame([("c0",)], "node string"), 3)


@query("g2_weakest_link", """WITH RECURSIVE e AS (SELECT id AS src, replaced_by AS dst FROM (SELECT o_orderkey AS id, o_orderkey + 1 AS replaced_by FROM orders)), c AS (SELECT o_orderkey AS node, (o_orderkey % 101) / 100.0::DOUBLE AS confidence FROM orders),
 r AS (SELECT node, 0 AS hop, confidence AS weakest FROM c WHERE node % 100 = 0 UNION ALL SELECT c.node, r.hop + 1, least(r.weakest, c.confidence) FROM r JOIN e ON r.node = e.src JOIN c ON c.node = e.dst WHERE r.hop < 3) SELECT node, hop, weakest FROM r""")
def g2(spark, d):
    c = A.claims(spark, d)
    return X.weakest_link(c.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), c.filter("id % 100 = 0").select(F.col("id").alias("node")), c.select(F.col("id").alias("node"), "confidence"), 3)


@query("g4_edge_rebuild", "WITH l AS (SELECT DISTINCT claim_id, source * 1000 + part % 1000 AS e FROM citations), k AS (SELECT e FROM l GROUP BY e HAVING count(*) BETWEEN 2 AND 50) SELECT a.claim_id AS src, b.claim_id AS dst, count(*) AS shared FROM l a JOIN l b ON a.e = b.e AND a.claim_id < b.claim_id JOIN k ON a.e = k.e GROUP BY ALL", CITATIONS)
def g4(spark, d):
    return X.shared_entity_edges(A.citations(spark, d).withColumn("source", F.col("source") * 1000 + F.col("part") % 1000), 2, 50)


@query("g8_hebbian_weight", "SELECT least(source, part) AS src, greatest(source, part) AS dst, count(DISTINCT claim_id) AS supports, round(1.0 + 0.1 * (count(DISTINCT claim_id) - 1), 6)::DOUBLE AS weight FROM citations GROUP BY 1, 2", CITATIONS)
def g8(spark, d):
    return X.hebbian(A.citations(spark, d).select(F.col("source").alias("src"), F.col("part").alias("dst"), F.col("claim_id").alias("support")))


@query("g9_components", """WITH RECURSIVE b AS (SELECT subject AS u, id AS v FROM (SELECT o_custkey * 100000 AS subject, o_orderkey AS id FROM orders) UNION SELECT id, subject FROM (SELECT o_custkey * 100000 AS subject, o_orderkey AS id FROM orders)),
 r AS (SELECT u AS node, u AS low FROM b UNION SELECT b.v, r.low FROM r JOIN b ON r.node = b.u) SELECT node, min(low) AS component FROM r GROUP BY node""")
def g9(spark, d):
    x = A.claims(spark, d).select((F.col("subject") * 100000).alias("src"), F.col("id").alias("dst"))
    return X.components(x)


@query("v5_promotion_ladder", """WITH n AS (SELECT claim_id, count(*) AS k FROM citations GROUP BY 1), r AS (SELECT subject, predicate, scope, first(struct_pack(id, object_value, confidence) ORDER BY confidence DESC, updated_at DESC, id DESC) AS r FROM claims WHERE status = 'confirmed' GROUP BY ALL),
 x AS (SELECT c.id, coalesce(k, 0) AS cites, c.object_value, r.r AS r, greatest(0.0, least(1.0, (0.35::DOUBLE + least(coalesce(k, 0) * 0.12::DOUBLE, 0.4) + least((length(predicate) + length(c.object_value)) / 240.0::DOUBLE, 0.15) + 0.1) * 0.75 + c.confidence * 0.25)) AS score FROM claims c LEFT JOIN n ON c.id = claim_id LEFT JOIN r USING (subject, predicate, scope) WHERE c.status = 'candidate')
 SELECT id, cites, round(score, 6) AS score, r.id AS rival_id, CASE WHEN cites = 0 OR score < 0.58 THEN 'pending' WHEN r IS NULL THEN 'confirmed' WHEN lower(trim(object_value)) = lower(trim(r.object_value)) THEN 'duplicate' WHEN score <= r.confidence + 0.08 THEN 'conflicted' ELSE 'supersedes' END AS verdict FROM x""", CLAIMS, CITATIONS)
def v5(spark, d):
    return G.promotion_ladder(A.claims(spark, d), A.citations(spark, d))


@query("v12_tiers", f"SELECT id, CASE WHEN access_count > 5 OR {hours('updated_at')} / 24.0 < 7 THEN 'core' WHEN access_count = 0 AND {hours('updated_at')} / 24.0 >= 90 THEN 'peripheral' ELSE 'working' END AS tier FROM claims", CLAIMS)
def v12(spark, d):
    return G.tiers(A.claims(spark, d), AT()).select("id", "tier")


@query("v13_steward_decision", """WITH m AS (SELECT subject, predicate, scope, max(struct_pack(u := updated_at, i := id)) AS m FROM claims WHERE status = 'confirmed' GROUP BY ALL)
 SELECT id, CASE WHEN m.i <> id AND m.u > updated_at THEN 'superseded_candidate' WHEN status = 'conflicted' THEN 'conflict' WHEN status = 'stale' THEN 'stale' ELSE 'keep' END AS decision FROM claims LEFT JOIN m USING (subject, predicate, scope) WHERE status <> 'archived'""", CLAIMS)
def v13(spark, d):
    return G.steward_decisions(A.claims(spark, d))


@query("v16_scheduled_archive", f"SELECT id FROM claims WHERE status = 'stale' AND access_count <= 2 AND updated_at < {NOW} - INTERVAL 14 DAY ORDER BY updated_at, id LIMIT 500", CLAIMS)
def v16(spark, d):
    return A.claims(spark, d).filter((F.col("status") == "stale") & (F.col("access_count") <= 2) & (F.col("updated_at") < AT() - F.make_dt_interval(F.lit(14)))).orderBy("updated_at", "id").limit(500).select("id")


@query("r3_recall_counters", "SELECT event_type, count(*) AS n, round(avg((value < 10)::INT), 6) AS zero_rate, round(avg(value), 4) AS mean, max(value) AS most FROM ledger GROUP BY event_type", LEDGER)
def r3(spark, d):
    return A.ledger(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") < 10).cast("int")), 6).alias("zero_rate"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"))


@query("r5_vault_lint", f"SELECT (SELECT count(*) FROM claims WHERE id NOT IN (SELECT claim_id FROM citations)) AS orphans, (SELECT count(*) FROM (SELECT 1 FROM claims GROUP BY subject, predicate, scope HAVING count(DISTINCT object_value) > 1)) AS contradictions, (SELECT count(*) FROM claims WHERE updated_at < {NOW} - INTERVAL 30 DAY AND status = 'confirmed') AS stale", CLAIMS, CITATIONS)
def r5(spark, d):
    c = A.claims(spark, d)
    a = c.join(A.citations(spark, d), F.col("id") == F.col("claim_id"), "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    b = c.groupBy("subject", "predicate", "scope").agg(F.countDistinct("object_value").alias("v")).filter("v > 1").agg(F.count(F.lit(1)).alias("contradictions"))
    e = c.filter((F.col("updated_at") < AT() - F.make_dt_interval(F.lit(30))) & (F.col("status") == "confirmed")).agg(F.count(F.lit(1)).alias("stale"))
    one = F.lit(1)
    return a.withColumn("k", one).join(b.withColumn("k", one), "k").join(e.withColumn("k", one), "k").drop("k")


@query("r9_evidence_top_n", "SELECT claim_id, source, locator, total > 2 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY created_at DESC, locator, source, part) AS r, count(*) OVER (PARTITION BY claim_id) AS total FROM citations) WHERE r <= 2", CITATIONS)
def r9(spark, d):
    w = W.partitionBy("claim_id")
    x = A.citations(spark, d).withColumn("r", F.row_number().over(w.orderBy(F.desc("created_at"), "locator", "source", "part"))).withColumn("total", F.count(F.lit(1)).over(w))
    return x.filter("r <= 2").select("claim_id", "source", "locator", (F.col("total") > 2).alias("has_more"))


@query("r17_sources_left", "SELECT claim_id, count(DISTINCT source) FILTER (source % 5 <> 0) AS left_sources FROM citations GROUP BY claim_id HAVING count(DISTINCT source) FILTER (source % 5 <> 0) = 0", CITATIONS)
def r17(spark, d):
    return A.citations(spark, d).groupBy("claim_id").agg(F.countDistinct(F.when(F.col("source") % 5 != 0, F.col("source"))).alias("left_sources")).filter("left_sources = 0")


@query("r18_due_work", "SELECT id, created_at FROM claims c WHERE status = 'confirmed' AND NOT EXISTS (SELECT 1 FROM citations t WHERE t.claim_id = c.id AND t.created_at > c.created_at)", CLAIMS, CITATIONS)
def r18(spark, d):
    c, t = A.claims(spark, d).filter("status = 'confirmed'").alias("c"), A.citations(spark, d).alias("t")
    return c.join(t, (F.col("c.id") == F.col("t.claim_id")) & (F.col("t.created_at") > F.col("c.created_at")), "left_anti").select("id", "created_at")


@query("e3_confusion_f1", """WITH x AS (SELECT count(*) FILTER (a AND p) AS tp, count(*) FILTER (NOT a AND p) AS fp, count(*) FILTER (a AND NOT p) AS fn, count(*) FILTER (NOT a AND NOT p) AS tn FROM (SELECT status IN ('stale','conflicted') AS a, confidence < 0.4 AS p FROM claims))
 SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN 2*tp + fp + fn > 0 THEN round(2.0 * tp / (2*tp + fp + fn), 6) ELSE 0.0 END AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM x""", CLAIMS)
def e3(spark, d):
    return E.confusion(A.claims(spark, d), F.col("status").isin("stale", "conflicted"), F.col("confidence") < 0.4)


@query("e4_pareto_frontier", """WITH n AS (SELECT claim_id, count(*) AS k FROM citations GROUP BY 1), s AS (SELECT c.*, coalesce(k, 0) AS k FROM claims c LEFT JOIN n ON id = claim_id),
 g AS (SELECT c.c, t.t FROM (SELECT unnest([1,2,3,4]) AS c) c, (SELECT unnest([0.2,0.4,0.6,0.8])::DOUBLE AS t) t),
 p AS (SELECT g.c AS min_citations, g.t AS min_confidence, round(avg((k >= g.c AND confidence >= g.t AND status IN ('stale','conflicted'))::INT), 6) AS cost, round(avg((k >= g.c AND confidence >= g.t)::INT), 6) AS gain FROM s, g GROUP BY 1, 2)
 SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.cost <= p.cost AND q.gain >= p.gain AND (q.cost < p.cost OR q.gain > p.gain))""", CLAIMS, CITATIONS)
def e4(spark, d):
    s = C.with_citations(A.claims(spark, d), A.citations(spark, d)).select("status", "confidence", F.col("n_citations").alias("k"))
    grid = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c in (1, 2, 3, 4) for t in (0.2, 0.4, 0.6, 0.8)])
    ok = (F.col("k") >= F.col("g.c")) & (F.col("confidence") >= F.col("g.t"))
    # Counts per (citations, confidence, status) first, so that the grid multiplies a small table.
    small = s.groupBy("k", "confidence", "status").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.explode(grid))
    p = small.groupBy(F.col("g.c").alias("min_citations"), F.col("g.t").alias("min_confidence")).agg(F.round(F.sum(F.when(ok & F.col("status").isin("stale", "conflicted"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("cost"), F.round(F.sum(F.when(ok, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("gain"))
    return E.frontier(p, "cost", "gain")
