"""Further queries: sinks' contents, lifecycle jobs, entities, clusters, evaluation and audits."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from claimforge.functions import text as T
from claimforge.operators import claims as C, governance as G, graph as X, knowledge as N, lifecycle as L, matching as M, search as S
from claimforge.plans.base import CITATIONS, CLAIMS, LEDGER, NOTES, TURNS, hours, query
from claimforge.plans.textual import BM25, COS
from claimforge.sources import adapters as A



def one():
    return F.count(F.lit(1))


@query("s12_webhook_turns", "SELECT event_id AS id, user_id AS session_id, 'user' AS role, event_type || ' ' || json_extract(props, '$.k')::VARCHAR AS content FROM events")
def s12(spark, d):
    return A.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.lit("user").alias("role"), F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("content"))


@query("k4_rules_export", "WITH r AS (SELECT id, subject, confidence FROM claims WHERE status = 'confirmed' AND confidence >= 0.5 ORDER BY id LIMIT 200), n AS (SELECT subject, count(*) AS c FROM claims WHERE status = 'conflicted' GROUP BY 1) SELECT id, confidence, coalesce(c, 1) AS corrections FROM r LEFT JOIN n USING (subject)", CLAIMS)
def k4(spark, d):
    c = A.claims(spark, d)
    r = c.filter("status = 'confirmed' AND confidence >= 0.5").orderBy("id").limit(200).select("id", "subject", "confidence")
    n = c.filter("status = 'conflicted'").groupBy("subject").agg(one().alias("c"))
    return r.join(n, "subject", "left").select("id", "confidence", F.coalesce("c", F.lit(1)).alias("corrections"))


@query("k5_vault_pages", "SELECT subject, '# ' || subject || chr(10) || string_agg('- ' || predicate || ': ' || object_value, chr(10) ORDER BY id) AS page FROM claims WHERE status = 'confirmed' GROUP BY subject", CLAIMS)
def k5(spark, d):
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "predicate", "object_value"))), lambda x: F.concat(F.lit("- "), x.predicate, F.lit(": "), x.object_value)), "\n")
    return A.claims(spark, d).filter("status = 'confirmed'").groupBy("subject").agg(lines.alias("l")).select("subject", F.concat(F.lit("# "), F.col("subject").cast("string"), F.lit("\n"), F.col("l")).alias("page"))


@query("k6_prometheus_text", "SELECT 'claims_total{status=\"' || status || '\"} ' || count(*) AS line FROM claims GROUP BY status", CLAIMS)
def k6(spark, d):
    return A.claims(spark, d).groupBy("status").agg(one().alias("n")).select(F.concat(F.lit('claims_total{status="'), "status", F.lit('"} '), F.col("n").cast("string")).alias("line"))


@query("k7_approved_actions", "SELECT id, to_json({'id': id, 'claim': claim_id})::VARCHAR AS line FROM ledger WHERE to_status = 'confirmed'", LEDGER)
def k7(spark, d):
    return A.ledger(spark, d).filter("to_status = 'confirmed'").select("id", F.to_json(F.struct("id", F.col("claim_id").alias("claim"))).alias("line"))


@query("p9_mutable_state", "SELECT id, CASE WHEN regexp_matches(lower(text), '\\b(server|port|service|host|deploy)\\b') AND regexp_matches(lower(text), '\\b(running|down|up|busy|failing|current|currently)\\b') THEN 'high' ELSE 'low' END AS volatility FROM notes", NOTES)
def p9(spark, d):
    return A.notes(spark, d).select("id", L.mutable_state(F.col("text"), F.lit("low"), F.lit(True)).alias("volatility"))


@query("p15_evidence_policy", "SELECT source % 4 = 0 AS synthetic, count(*) AS n FROM citations WHERE source % 4 <> 0 GROUP BY 1", CITATIONS)
def p15(spark, d):
    return A.citations(spark, d).withColumn("synthetic", F.col("source") % 4 == 0).filter("NOT synthetic").groupBy("synthetic").agg(one().alias("n"))


@query("j8_fk_repair", "SELECT l_orderkey AS missing, count(*) AS rows, 'lineitem.order' AS fk FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1 UNION ALL SELECT replaced_by, count(*), 'claims.replaced_by' FROM claims WHERE replaced_by IS NOT NULL AND replaced_by NOT IN (SELECT id FROM claims) GROUP BY 1 UNION ALL SELECT source, count(*), 'citations.active_source' FROM citations WHERE source % 25 = 0 OR source NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1", CLAIMS, CITATIONS)
def j8(spark, d):
    c = A.claims(spark, d)
    return L.foreign_keys(A.read(spark, d, "lineitem"), "l_orderkey", c, "id", "lineitem.order").unionByName(L.foreign_keys(c, "replaced_by", c, "id", "claims.replaced_by")).unionByName(L.foreign_keys(A.citations(spark, d), "source", A.read(spark, d, "supplier").filter("s_suppkey % 25 <> 0"), "s_suppkey", "citations.active_source"))


@query("j18_unsummarized_archived", "SELECT id FROM claims WHERE status = 'archived' AND id NOT IN (SELECT claim_id FROM citations WHERE source % 2 = 0)", CLAIMS, CITATIONS)
def j18(spark, d):
    t = A.citations(spark, d).filter("source % 2 = 0")
    return A.claims(spark, d).filter("status = 'archived'").join(t, F.col("id") == F.col("claim_id"), "left_anti").select("id")


@query("j20_context_bundle", """SELECT 'claims' AS section, id, confidence AS score FROM (SELECT id, confidence FROM claims WHERE status = 'confirmed' ORDER BY confidence DESC, id LIMIT 20) UNION ALL SELECT 'events', id, value FROM (SELECT id, value FROM ledger ORDER BY value DESC, id LIMIT 10) UNION ALL SELECT 'conflicts', id, confidence FROM (SELECT id, confidence FROM claims WHERE status = 'conflicted' ORDER BY confidence DESC, id LIMIT 5)""", CLAIMS, LEDGER)
def j20(spark, d):
    c = A.claims(spark, d)
    return N.bundle([("claims", c.filter("status = 'confirmed'").withColumn("score", F.col("confidence")), 20), ("events", A.ledger(spark, d).withColumn("score", F.col("value")), 10), ("conflicts", c.filter("status = 'conflicted'").withColumn("score", F.col("confidence")), 5)])


@query("a9_graph_stats", "SELECT count(*) AS edges, count(DISTINCT claim_id) AS claims, count(DISTINCT source) AS entities FROM (SELECT DISTINCT claim_id, source FROM citations)", CITATIONS)
def a9(spark, d):
    return A.citations(spark, d).select("claim_id", "source").distinct().agg(one().alias("edges"), F.countDistinct("claim_id").alias("claims"), F.countDistinct("source").alias("entities"))


@query("a22_usage_window", "SELECT event_type AS tool, count(*) AS calls, count(DISTINCT claim_id) AS users FROM ledger WHERE created_at >= TIMESTAMP '2024-01-20' GROUP BY 1", LEDGER)
def a22(spark, d):
    return A.ledger(spark, d).filter(F.col("created_at") >= A.now("2024-01-20 00:00:00")).groupBy(F.col("event_type").alias("tool")).agg(one().alias("calls"), F.countDistinct("claim_id").alias("users"))


@query("a15_decision_clusters", """WITH RECURSIVE b AS (SELECT DISTINCT 'p' || predicate || subject AS u, 'i' || id AS v FROM (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS predicate FROM orders)), e AS (SELECT u, v FROM b UNION SELECT v, u FROM b),
 r AS (SELECT u AS node, u AS low FROM e UNION SELECT e.v, r.low FROM r JOIN e ON r.node = e.u), c AS (SELECT node, min(low) AS component FROM r GROUP BY node) SELECT component, count(*) AS n FROM c GROUP BY component""")
def a15(spark, d):
    x = A.claims(spark, d).select(F.concat(F.lit("p"), "predicate", F.col("subject").cast("string")).alias("src"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("dst"))
    return X.components(x).groupBy("component").agg(one().alias("n"))


@query("w7_auto_gate", "SELECT prompt_id, (max(score) > 0)::INT + (max(confidence) > 0)::INT + (max(CASE WHEN scope = 'fr' THEN 1 ELSE 0 END) > 0)::INT AS streams, (max(score) > 0)::INT + (max(confidence) > 0)::INT + (max(CASE WHEN scope = 'fr' THEN 1 ELSE 0 END) > 0)::INT >= 3 AS use_rrf FROM bm JOIN notes USING (id) GROUP BY prompt_id", NOTES, BM25)
def w7(spark, d):
    n = A.notes(spark, d)
    x = S.bm25(n, A.prompts(spark, d)).join(n.select("id", "confidence", "scope"), "id")
    g = x.groupBy("prompt_id").agg(F.max("score").alias("s"), F.max("confidence").alias("c"), F.max((F.col("scope") == "fr").cast("int")).alias("f"))
    return g.withColumn("streams", (F.col("s") > 0).cast("int") + (F.col("c") > 0).cast("int") + F.col("f")).select("prompt_id", "streams", (F.col("streams") >= 3).alias("use_rrf"))


RT = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9_]+'), lambda t: length(t) >= 3 AND t NOT IN (" + ",".join(f"'{w}'" for w in T.RANK_STOP) + ")))"


@query("u2_token_fanout", f"WITH q AS (SELECT item_id AS prompt_id, unnest(list_sort({RT.format('text')})[1:6]) AS term FROM benchmark), p AS (SELECT id, confidence, unnest({RT.format('text')}) AS term FROM notes), h AS (SELECT prompt_id, id FROM q JOIN p USING (term) QUALIFY row_number() OVER (PARTITION BY prompt_id, term ORDER BY confidence DESC, id) <= 3) SELECT DISTINCT prompt_id, id FROM h", NOTES)
def u2(spark, d):
    q = A.prompts(spark, d).select("prompt_id", F.explode(F.slice(F.sort_array(T.rank_tokens(F.col("prompt"))), 1, 6)).alias("term"))
    p = A.notes(spark, d).select("id", "confidence", F.explode(T.rank_tokens(F.col("text"))).alias("term"))
    return N.first_per(p.join(q, "term"), ["prompt_id", "term"], [F.desc("confidence"), "id"], 3).select("prompt_id", "id").distinct()


@query("u5_entity_merge", "SELECT kind, surface, min(id) AS first_id, count(*) AS docs FROM (SELECT id, 'ipv4' AS kind, unnest(list_distinct(regexp_extract_all(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'))) AS surface FROM notes UNION ALL SELECT id, 'email', unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) FROM notes) GROUP BY kind, surface", NOTES)
def u5(spark, d):
    x = A.notes(spark, d).select("id", F.explode(T.entities(F.col("text"))).alias("e")).select("id", "e.kind", "e.surface").filter(F.col("kind").isin("ipv4", "email"))
    return x.groupBy("kind", "surface").agg(F.min("id").alias("first_id"), one().alias("docs"))


@query("f2_recall_tokens", "SELECT item_id AS prompt_id, len(regexp_extract_all(text, '[A-Za-zÀ-ɏ][A-Za-z0-9À-ɏ_-]{2,}')) AS n FROM benchmark")
def f2(spark, d):
    return A.prompts(spark, d).select("prompt_id", F.size(T.recall_tokens(F.col("prompt"))).alias("n"))


@query("f5_tier_bonus", f"SELECT CASE WHEN access_count > 5 OR {hours('updated_at')} / 24.0 < 7 THEN 0.15 WHEN access_count = 0 AND {hours('updated_at')} / 24.0 >= 90 THEN -0.10 ELSE 0.0 END::DOUBLE AS bonus, count(*) AS n FROM claims GROUP BY 1", CLAIMS)
def f5(spark, d):
    return G.tiers(A.claims(spark, d), A.now(A.NOW_CLAIMS)).groupBy(G.choose("tier", G.TIER_BONUS, 0.0).alias("bonus")).agg(one().alias("n"))


@query("f9_recall_linear", "WITH m AS (SELECT prompt_id, max(score) AS top FROM bm GROUP BY 1) SELECT prompt_id, id, round((0.3 * score / top + 0.1 * confidence)::DOUBLE * CASE WHEN status = 'confirmed' THEN 1.2 ELSE 1.0 END, 6) AS linear FROM bm JOIN m USING (prompt_id) JOIN notes USING (id) WHERE score >= top * 0.8", NOTES, BM25)
def f9(spark, d):
    n = A.notes(spark, d)
    x = S.bm25(n, A.prompts(spark, d)).withColumn("top", F.max("score").over(W.partitionBy("prompt_id"))).filter(F.col("score") >= F.col("top") * 0.8).join(n.select("id", "confidence", "status"), "id")
    return x.select("prompt_id", "id", F.round((0.3 * F.col("score") / F.col("top") + 0.1 * F.col("confidence")) * F.when(F.col("status") == "confirmed", 1.2).otherwise(1.0), 6).alias("linear"))


@query("f15_rendered_blocks", "SELECT id, printf('<claim id=\"%d\" status=\"%s\" confidence=\"%.2f\"/>', id, status, confidence) AS block FROM claims", CLAIMS)
def f15(spark, d):
    return N.rendered(A.claims(spark, d))


@query("f18_turn_claims", "SELECT id, kind, v FROM (SELECT id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS v FROM notes UNION ALL SELECT id, 'token', unnest(regexp_extract_all(text, '(?:token|secret)\\s*=\\s*(\\S+)', 1)) FROM notes)", NOTES)
def f18(spark, d):
    n = A.notes(spark, d)
    a = n.select("id", F.lit("email").alias("kind"), F.explode(T.all_matches(F.col("text"), T.ENTITY_PATTERNS["email"])).alias("v"))
    return a.unionByName(n.select("id", F.lit("token").alias("kind"), F.explode(T.all_matches(F.col("text"), r"(?:token|secret)\s*=\s*(\S+)", 1)).alias("v")))


@query("f25_human_ids", "SELECT id, 'mm-' || substr(sha256(id::VARCHAR), 1, 4) || CASE WHEN row_number() OVER (PARTITION BY substr(sha256(id::VARCHAR), 1, 4) ORDER BY id) > 1 THEN '-' || row_number() OVER (PARTITION BY substr(sha256(id::VARCHAR), 1, 4) ORDER BY id) ELSE '' END AS human_id FROM claims", CLAIMS)
def f25(spark, d):
    x = A.claims(spark, d).select("id", F.substring(F.sha2(F.col("id").cast("string").cast("binary"), 256), 1, 4).alias("h"))
    x = x.withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("id")))
    return x.select("id", F.concat(F.lit("mm-"), "h", F.when(F.col("r") > 1, F.concat(F.lit("-"), F.col("r").cast("string"))).otherwise("")).alias("human_id"))


@query("f31_closet_search", "SELECT prompt_id, id, round(score / max(score) OVER (PARTITION BY prompt_id), 6) AS ratio FROM bm QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) <= 5", NOTES, BM25)
def f31(spark, d):
    x = S.bm25(A.notes(spark, d), A.prompts(spark, d)).withColumn("ratio", F.round(F.col("score") / F.max("score").over(W.partitionBy("prompt_id")), 6))
    return S.top(x, ["prompt_id"], [F.desc("score"), "id"], 5).select("prompt_id", "id", "ratio")


@query("f37_tfidf_similarity", """WITH t AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) AS term FROM benchmark), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), size AS (SELECT count(DISTINCT id) AS n FROM tf), w AS (SELECT id, term, tf * ln((1.0::DOUBLE + size.n) / (1.0 + df)) AS w FROM tf JOIN df USING (term), size),
 l AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id), u AS (SELECT id, term, w / norm AS u FROM w JOIN l USING (id) WHERE w > 0) SELECT a.id AS a, b.id AS b, round(sum(a.u * b.u), 6) AS cos FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY ALL HAVING sum(a.u * b.u) >= 0.05 - 1e-9""")
def f37(spark, d):
    t = A.prompts(spark, d).select(F.col("prompt_id").alias("id"), F.explode(T.all_matches(F.lower("prompt"), "[a-z0-9_]{3,}")).alias("term")).groupBy("id", "term").agg(one().alias("tf"))
    v = M.tfidf_vectors(t, F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))), t.agg(F.countDistinct("id").alias("n_docs")))
    return M.tfidf_pairs(v, 0.05)


@query("f40_trust_scores", "SELECT id, CASE WHEN source_agent IS NULL THEN 0.2 WHEN source_agent::INT < 5 THEN 0.9 WHEN source_agent::INT < 12 THEN 0.6 ELSE 0.4 END::DOUBLE AS trust FROM claims", CLAIMS)
def f40(spark, d):
    a = F.col("source_agent").cast("int")
    return A.claims(spark, d).select("id", F.when(a.isNull(), 0.2).when(a < 5, 0.9).when(a < 12, 0.6).otherwise(0.4).alias("trust"))


@query("f42_scope_slugs", "SELECT DISTINCT source, trim(regexp_replace(lower('Project ' || source), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def f42(spark, d):
    return A.read(spark, d, "documents").select("source", F.trim(F.regexp_replace(F.lower(F.concat(F.lit("Project "), "source")), "[^a-z0-9]+", "-"), F.lit("-")).alias("slug")).distinct()


@query("f43_iso_parse", "SELECT id, try_cast(CASE WHEN id % 3 = 0 THEN 'soon' ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S') END AS TIMESTAMP) AS parsed FROM claims", CLAIMS)
def f43(spark, d):
    raw = F.when(F.col("id") % 3 == 0, "soon").otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return A.claims(spark, d).select("id", raw.try_cast("timestamp_ntz").alias("parsed"))


@query("f44_payload_errors", "SELECT id FROM ledger WHERE json_extract(payload, '$.k') IS NULL OR (event_type = 'decay' AND json_extract(payload, '$.k')::INT > 90)", LEDGER)
def f44(spark, d):
    return L.payload_errors(A.ledger(spark, d)).select("id")


@query("f45_path_collapse", "SELECT page_id AS id, CASE WHEN url LIKE 'https://%' THEN '[tls]/' || substr(url, 9) WHEN url LIKE 'http://%' THEN '[plain]/' || substr(url, 8) ELSE url END AS path FROM pages")
def f45(spark, d):
    u = F.col("slug")
    return A.articles(spark, d).select("id", F.when(u.startswith("https://"), F.concat(F.lit("[tls]/"), F.substring(u, 9, 1 << 20))).when(u.startswith("http://"), F.concat(F.lit("[plain]/"), F.substring(u, 8, 1 << 20))).otherwise(u).alias("path"))


@query("g1_bfs_paths", """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS src, l_suppkey + 1000000 AS dst FROM lineitem), r AS (SELECT 0::BIGINT AS node, 0 AS hop, '0' AS path UNION ALL SELECT b.dst, hop + 1, path || '>' || b.dst FROM r JOIN (SELECT src, dst FROM e UNION SELECT dst, src FROM e) b ON r.node = b.src WHERE hop < 2)
 SELECT node, min(hop) AS hop, first(path ORDER BY hop, path) AS path FROM r GROUP BY node""")
def g1(spark, d):
    e = A.citations(spark, d).select(F.col("claim_id").alias("src"), (F.col("source") + 1000000).alias("dst")).distinct()
    both = e.union(e.select("dst", "src"))
    return N.paths(both, spark.createDataFrame([(0,)], "node long"), 2)


@query("g5_weighted_reach", """WITH RECURSIVE e AS (SELECT id AS src, replaced_by AS dst, w FROM (SELECT o_orderkey AS id, o_orderkey + 1 AS replaced_by, 0.5 + (o_orderkey % 5) / 10.0::DOUBLE AS w FROM orders)), r AS (SELECT o_orderkey AS node, 1.0::DOUBLE AS weight, 0 AS h FROM orders WHERE o_orderkey % 500 = 0 UNION ALL SELECT e.dst, r.weight * e.w, h + 1 FROM r JOIN e ON r.node = e.src WHERE h < 3)
 SELECT node, round(max(weight), 6) AS weight FROM r GROUP BY node""")
def g5(spark, d):
    c = A.claims(spark, d)
    e = c.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), (0.5 + (F.col("id") % 5) / 10.0).alias("weight"))
    return N.reach(e, c.filter("id % 500 = 0").select(F.col("id").alias("node")), 3).select("node", F.round("weight", 6).alias("weight"))


@query("g7_entity_hops", """WITH RECURSIVE b AS (SELECT DISTINCT 'c' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'c' || l_orderkey FROM lineitem), r AS (SELECT 's1' AS node, 0 AS hop UNION SELECT b.dst, hop + 1 FROM r JOIN b ON r.node = b.src WHERE hop < 2)
 SELECT node, round(1.0::DOUBLE / (1 + min(hop)), 6) AS score FROM r GROUP BY node""")
def g7(spark, d):
    e = A.citations(spark, d).select(F.concat(F.lit("c"), F.col("claim_id").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("source").cast("string")).alias("dst")).distinct()
    return X.hops(e, spark.createDataFrame([("s1",)], "node string"), 2).select("node", F.round(1.0 / (1 + F.col("hop")), 6).alias("score"))


@query("g10_signatures", "SELECT DISTINCT sha256(concat_ws('|', least(source, part)::VARCHAR, 'related_to', greatest(source, part)::VARCHAR, 'v1')) AS signature FROM citations", CITATIONS)
def g10(spark, d):
    return A.citations(spark, d).select(N.signature(F.col("source"), "related_to", F.col("part"), True).alias("signature")).distinct()


@query("g12_entity_resolve", "SELECT regexp_replace(regexp_replace(lower(trim(p_type)), '[\\s_\\-.]+', '-', 'g'), '^-+|-+$', '', 'g') AS alias_key, min(p_partkey) AS entity_id, count(DISTINCT p_type) AS variants, count(*) AS mentions FROM part GROUP BY 1")
def g12(spark, d):
    return N.resolve_entities(A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("surface")), T.alias_key(F.col("surface")))


@query("g14_embedding_leaders", "WITH p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.scope = b.scope AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.3), s AS (SELECT a AS x, b AS y FROM p UNION ALL SELECT b, a FROM p) SELECT x, least(min(y), x) AS leader, count(*) AS neighbours FROM s GROUP BY x", COS)
def g14(spark, d):
    return N.greedy_clusters(S.similar_pairs(A.vectors(spark, d), 0.3))


KEY = "'hash-' || substr(sha256(lower(trim(text)) || '|' || scope || '|' || 'default'), 1, 16)"


@query("v1_ingest", f"WITH n AS (SELECT {KEY} AS key, id, scope, source_agent FROM notes WHERE id % 2 = 1), f AS (SELECT key, min(id) AS id FROM n GROUP BY key), g AS (SELECT n.* FROM f JOIN n USING (key, id) WHERE key NOT IN (SELECT {KEY} FROM notes WHERE id % 2 = 0)) SELECT key, id, scope, source_agent FROM g QUALIFY row_number() OVER (PARTITION BY source_agent ORDER BY id) <= 20", NOTES)
def v1(spark, d):
    n = A.notes(spark, d)
    return L.ingest(n.filter("id % 2 = 1"), n.filter("id % 2 = 0"), 20)


@query("v7_stale_by_files", "SELECT claim_id, count(DISTINCT source) AS changed_sources FROM citations JOIN supplier ON source = s_suppkey WHERE TIMESTAMP '1995-01-01' + to_days((s_suppkey % 2000)::INT) > created_at GROUP BY claim_id", CITATIONS)
def v7(spark, d):
    files = A.read(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), (A.now("1995-01-01 00:00:00") + F.make_dt_interval((F.col("s_suppkey") % 2000).cast("int"))).alias("changed_at"))
    return L.stale_by_files(A.citations(spark, d), files)


COMPACT = "SELECT subject, predicate, scope, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS citations, string_agg(id::VARCHAR, ',' ORDER BY id) AS members, count(*) FILTER (status = 'stale') AS stale FROM claims LEFT JOIN (SELECT claim_id, count(*) AS k FROM citations GROUP BY 1) ON id = claim_id WHERE status IN ('stale','superseded','conflicted') AND NOT pinned GROUP BY ALL"


@query("v10_compaction", COMPACT, CLAIMS, CITATIONS)
def v10(spark, d):
    return L.compaction(A.claims(spark, d), A.citations(spark, d))


@query("r24_untraced", "SELECT count(*) AS untraced FROM claims WHERE false", CLAIMS)
def r24(spark, d):
    c = A.claims(spark, d)
    return L.untraced(L.compaction(c, A.citations(spark, d)), c).agg(one().alias("untraced"))


@query("v15_contradiction_cache", "WITH p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.scope = b.scope AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.3 AND list_cosine_similarity(a.v, b.v) < 0.4) SELECT (a + b) % 3 = 0 AS cached, count(*) AS n FROM p GROUP BY 1", COS)
def v15(spark, d):
    p = S.similar_pairs(A.vectors(spark, d), 0.3, 0.4).select("a", "b")
    cache = p.filter((F.col("a") + F.col("b")) % 3 == 0).withColumn("verdict", F.lit("no"))
    return p.join(cache, ["a", "b"], "left").groupBy(F.col("verdict").isNotNull().alias("cached")).agg(one().alias("n"))


@query("v18_rule_mining", "SELECT u.id, (SELECT max(a.id) FROM turns a WHERE a.session_id = u.session_id AND a.role = 'assistant' AND a.id < u.id) AS about FROM turns u WHERE role = 'user' AND id > 50000 AND contains(lower(content), 'the') AND EXISTS (SELECT 1 FROM turns a WHERE a.session_id = u.session_id AND a.role = 'assistant' AND a.id < u.id)", TURNS)
def v18(spark, d):
    x = C.preceding(A.turns(spark, d)).filter((F.col("id") > 50000) & F.lower("content").contains("the") & F.col("before_id").isNotNull())
    return x.select("id", F.col("before_id").alias("about"))


@query("v20_archive_by_source", "SELECT id FROM claims WHERE source_agent = '7' AND status <> 'archived'", CLAIMS)
def v20(spark, d):
    return A.claims(spark, d).filter("source_agent = '7' AND status <> 'archived'").select("id")


@query("v22_privacy_counts", "SELECT visibility, count(*) AS n, sum(length(text))::BIGINT AS chars FROM notes GROUP BY visibility", NOTES)
def v22(spark, d):
    return A.notes(spark, d).groupBy("visibility").agg(one().alias("n"), F.sum(F.length("text")).alias("chars"))


@query("v24_profile_facts", "SELECT part AS fact, count(DISTINCT claim_id % 50) AS sessions, max(created_at) AS last FROM citations GROUP BY part HAVING count(DISTINCT claim_id % 50) >= 10", CITATIONS)
def v24(spark, d):
    return A.citations(spark, d).groupBy(F.col("part").alias("fact")).agg(F.countDistinct(F.col("claim_id") % 50).alias("sessions"), F.max("created_at").alias("last")).filter("sessions >= 10")


@query("v26_integrity", "SELECT (SELECT count(*) FROM orders) - (SELECT count(DISTINCT o_orderkey) FROM orders) AS duplicate_ids, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans")
def v26(spark, d):
    o, i = A.read(spark, d, "orders"), A.read(spark, d, "lineitem")
    a = o.agg((one() - F.countDistinct("o_orderkey")).alias("duplicate_ids"), F.lit(1).alias("k"))
    b = i.join(o, i.l_orderkey == o.o_orderkey, "left_anti").agg(one().alias("orphans"), F.lit(1).alias("k"))
    return a.join(b, "k").drop("k")


@query("v27_shadow_admission", """WITH x AS (SELECT id, scope, md5(text) AS key, confidence AS support, greatest(1, length(text) // 4) AS tokens FROM notes), r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY scope, key ORDER BY id) > 1 THEN 'duplicate' WHEN support < 0.2 THEN 'weak_support' END AS reason FROM x)
 SELECT id, coalesce(reason, CASE WHEN sum(CASE WHEN reason IS NULL THEN tokens ELSE 0 END) OVER (PARTITION BY scope ORDER BY id) <= 20000 THEN 'admit' ELSE 'over_budget' END) AS decision FROM r""", NOTES)
def v27(spark, d):
    x = A.notes(spark, d).select("id", "scope", F.md5(F.col("text").cast("binary")).alias("key"), F.col("confidence").alias("support"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"))
    return L.shadow_admission(x, 20000, ["id"]).select("id", "decision")


@query("t6_watermark", "SELECT max(event_id) AS last_id, count(*) FILTER (event_id > 100) AS new_rows FROM events")
def t6(spark, d):
    return A.read(spark, d, "events").agg(F.max("event_id").alias("last_id"), F.count_if(F.col("event_id") > 100).alias("new_rows"))


@query("e5_bm25_grid", None)
def e5(spark, d):
    """Mean best score over a grid of k1 and b, by one pass over term statistics with a sum for each point of the grid."""
    n, p = A.notes(spark, d), A.prompts(spark, d)
    words = n.select("id", T.all_matches(F.lower("text"), "[a-z0-9_]{3,}").alias("w")).filter(F.size("w") > 0).withColumn("len", F.size("w"))
    q = p.select("prompt_id", F.explode(T.rank_tokens(F.col("prompt"))).alias("term"))
    tf = words.select("id", "len", F.explode("w").alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy("id", "len", "term").agg(one().alias("tf"))
    df = tf.groupBy("term").agg(one().alias("df"))
    stats = words.agg(one().alias("n"), F.avg("len").alias("avg"))
    grid = [(k, b) for k in (0.9, 1.2, 1.6) for b in (0.25, 0.75)]
    x = tf.join(df, "term").join(F.broadcast(stats)).join(q, "term")  # stats is one row
    idf, names = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), [f"s{i}" for i in range(len(grid))]
    part = [idf * F.col("tf") * (k + 1) / (F.col("tf") + k * (1 - b + b * F.col("len") / F.col("avg"))) for k, b in grid]
    s = x.groupBy("prompt_id", "id").agg(*[F.sum(v).alias(c) for v, c in zip(part, names, strict=True)]).groupBy("prompt_id").agg(*[F.max(c).alias(c) for c in names])
    s = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k1"), F.lit(b).alias("b"), F.col(c).alias("s")) for (k, b), c in zip(grid, names, strict=True)])).alias("g"))
    return s.groupBy("g.k1", "g.b").agg(F.round(F.avg("g.s"), 6).alias("mean_best"))


@query("e6_macro_f1", "WITH c AS (SELECT k, count(*) FILTER (a = k AND p = k) AS tp, count(*) FILTER (a <> k AND p = k) AS fp, count(*) FILTER (a = k AND p <> k) AS fn FROM (SELECT status AS a, ['candidate','confirmed','stale'][id % 3 + 1] AS p FROM claims), (SELECT unnest(['candidate','confirmed','stale']) AS k) GROUP BY k) SELECT round(avg(CASE WHEN 2*tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2*tp + fp + fn) ELSE 0.0 END), 6) AS macro_f1 FROM c", CLAIMS)
def e6(spark, d):
    kinds = ("candidate", "confirmed", "stale")
    x = A.claims(spark, d).groupBy(F.col("status").alias("a"), A.pick(kinds, F.col("id") % 3).alias("p")).agg(one().alias("n")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in kinds])))
    s = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    a, p, k = F.col("a"), F.col("p"), F.col("k")
    c = x.groupBy("k").agg(s((a == k) & (p == k)).alias("tp"), s((a != k) & (p == k)).alias("fp"), s((a == k) & (p != k)).alias("fn"))
    return c.agg(F.round(F.avg(F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)), 6).alias("macro_f1"))


@query("e7_dedupe_audit", "SELECT date_trunc('month', created_at) AS month, count(*) AS n, count(DISTINCT subject) AS subjects FROM claims WHERE status = 'superseded' GROUP BY 1", CLAIMS)
def e7(spark, d):
    return A.claims(spark, d).filter("status = 'superseded'").groupBy(F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("month")).agg(one().alias("n"), F.countDistinct("subject").alias("subjects"))


@query("e8_stream_latency", "SELECT raw_type AS stream, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 4) AS mean FROM ledger GROUP BY 1", LEDGER)
def e8(spark, d):
    x = A.ledger(spark, d).groupBy(F.col("raw_type").alias("stream")).agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.99))).alias("p"), F.round(F.avg("value"), 4).alias("mean"))
    return x.select("stream", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p99"), "mean")


@query("e13_queue_alerts", "SELECT event_type, count(*) AS n, count(*) > 1900 AS alert FROM ledger GROUP BY event_type", LEDGER)
def e13(spark, d):
    return A.ledger(spark, d).groupBy("event_type").agg(one().alias("n")).withColumn("alert", F.col("n") > 1900)


@query("r2_explain", "SELECT id, round(0.55::DOUBLE * 0.5, 6) AS lexical_part, round(0.30::DOUBLE * confidence, 6) AS confidence_part, pinned FROM claims", CLAIMS)
def r2(spark, d):
    parts = F.struct(F.lit(S.NO_VECTOR[0] * 0.5).alias("lexical"), (S.NO_VECTOR[1] * F.col("confidence")).alias("confidence"))
    return A.claims(spark, d).withColumn("parts", parts).select("id", F.round("parts.lexical", 6).alias("lexical_part"), F.round("parts.confidence", 6).alias("confidence_part"), "pinned")


@query("r6_wiki_validate", "SELECT page_id AS id, CASE WHEN NOT contains(html, '</html>') THEN 'unclosed' WHEN NOT contains(html, '<h1>') THEN 'no_heading' WHEN length(html) > 20000 THEN 'long' ELSE 'ok' END AS code FROM pages")
def r6(spark, d):
    h = F.col("html")
    return A.articles(spark, d).select("id", F.when(~h.contains("</html>"), "unclosed").when(~h.contains("<h1>"), "no_heading").when(F.length(h) > 20000, "long").otherwise("ok").alias("code"))


@query("r7_claim_verification", "WITH u AS (SELECT id, unnest(list_distinct(regexp_extract_all(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'))) AS ref FROM notes) SELECT id, count(*) AS refs, count(*) FILTER (ref LIKE '1%') AS found FROM u GROUP BY id", NOTES)
def r7(spark, d):
    u = A.notes(spark, d).select("id", F.explode(F.array_distinct(T.all_matches(F.col("text"), T.IPV4))).alias("ref"))
    index = u.select(F.col("ref").alias("known")).filter(F.col("known").startswith("1")).distinct()
    return u.join(index, F.col("ref") == F.col("known"), "left").groupBy("id").agg(one().alias("refs"), F.count("known").alias("found"))


@query("r8_conflict_pairs", "SELECT a.id AS a, b.id AS b FROM claims a JOIN claims b ON a.subject = b.subject AND a.predicate = b.predicate AND a.scope = b.scope AND a.id < b.id WHERE a.status = 'conflicted' AND b.status = 'conflicted'", CLAIMS)
def r8(spark, d):
    c = A.claims(spark, d).filter("status = 'conflicted'").select("id", "subject", "predicate", "scope")
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, (F.col("a.subject") == F.col("b.subject")) & (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.scope") == F.col("b.scope")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("r10_recurring_rules", "SELECT subject, count(*) AS corrections FROM claims WHERE status IN ('superseded', 'conflicted') GROUP BY subject HAVING count(*) >= 3", CLAIMS)
def r10(spark, d):
    return A.claims(spark, d).filter(F.col("status").isin("superseded", "conflicted")).groupBy("subject").agg(one().alias("corrections")).filter("corrections >= 3")


@query("r12_seed_selection", "SELECT id FROM (SELECT id, confidence, row_number() OVER (PARTITION BY md5(text) ORDER BY id) AS r FROM notes WHERE visibility = 'public' AND status = 'confirmed' AND confidence >= 0.5) WHERE r = 1 ORDER BY confidence DESC, id LIMIT 50", NOTES)
def r12(spark, d):
    x = A.notes(spark, d).filter("visibility = 'public' AND status = 'confirmed' AND confidence >= 0.5").select("id", "confidence", F.md5(F.col("text").cast("binary")).alias("h"))
    return N.first_per(x, ["h"], ["id"], 1).orderBy(F.desc("confidence"), "id").limit(50).select("id")


@query("r14_scope_merge", "SELECT scope // 3 AS scope, subject, predicate, first(id ORDER BY confidence DESC, id DESC) AS id, count(*) AS merged FROM claims GROUP BY scope // 3, subject, predicate", CLAIMS)
def r14(spark, d):
    return L.scope_merge(A.claims(spark, d), F.floor(F.col("scope") / 3))


@query("r19_vector_drift", "SELECT count(*) FILTER (id % 10 = 3) AS missing, count(*) FILTER (id % 10 = 4) AS orphans, abs(count(*) FILTER (id % 10 <> 4) - count(*) FILTER (id % 10 <> 3)) AS drift FROM claims", CLAIMS)
def r19(spark, d):
    c = A.claims(spark, d).select("id")
    return L.drift(c.filter("id % 10 <> 4"), c.filter("id % 10 <> 3"))


@query("r20_session_binding", f"SELECT session_id, max(id) AS bound FROM turns WHERE role <> 'system' GROUP BY session_id HAVING max(id) % 2 = 1", TURNS)
def r20(spark, d):
    return A.turns(spark, d).filter("role <> 'system'").groupBy("session_id").agg(F.max("id").alias("bound")).filter("bound % 2 = 1")


@query("r22_settled_proposals", "SELECT l.id, c.status FROM ledger l JOIN claims c ON l.claim_id = c.id WHERE l.event_type = 'supersession' AND c.status IN ('superseded', 'archived')", LEDGER, CLAIMS)
def r22(spark, d):
    p = A.ledger(spark, d).filter("event_type = 'supersession'").select(F.col("id").alias("p"), "claim_id")
    return p.join(A.claims(spark, d).filter(F.col("status").isin("superseded", "archived")), F.col("claim_id") == F.col("id")).select(F.col("p").alias("id"), "status")


def _features(spark, d):
    x = C.with_citations(A.claims(spark, d), A.citations(spark, d))
    return x.select("id", "confidence", "n_citations", "n_sources", "access_count", (G.hours(F.col("created_at"), A.now(A.NOW_CLAIMS)) / 24.0).alias("age_days"), F.col("status").isin("confirmed", "stale").cast("double").alias("label"))


@query("f36_classifier_gate")
def f36(spark, d):
    from claimforge.operators import models

    x = _features(spark, d)
    return models.promotion_gate(x, "label", x.filter("id % 5 <> 0")).select("id", "probability", "promoted")


@query("v28_quality_model")
def v28(spark, d):
    from claimforge.operators import models

    x = _features(spark, d)
    return models.quality_model(x, "label", x.filter("id % 5 <> 0")).select("id", "probability")


@query("f11_query_expansion", f"WITH q AS (SELECT item_id AS prompt_id, unnest({RT.format('text')}) AS term FROM benchmark), t AS (SELECT unnest({RT.format('text')}) AS alias FROM notes), n AS (SELECT alias, count(*) AS popularity FROM t GROUP BY alias HAVING count(*) >= 3), h AS (SELECT prompt_id, term, alias FROM q JOIN n ON substr(term, 1, 4) = substr(alias, 1, 4) AND term <> alias WHERE length(term) >= 4 QUALIFY row_number() OVER (PARTITION BY prompt_id, term ORDER BY popularity DESC, length(alias), alias) <= 2) SELECT * FROM h", NOTES)
def f11(spark, d):
    q = A.prompts(spark, d).select("prompt_id", F.explode(T.rank_tokens(F.col("prompt"))).alias("term")).filter(F.length("term") >= 4)
    n = A.notes(spark, d).select(F.explode(T.rank_tokens(F.col("text"))).alias("alias")).groupBy("alias").agg(one().alias("popularity")).filter("popularity >= 3")
    x = q.join(n, (F.substring("term", 1, 4) == F.substring("alias", 1, 4)) & (F.col("term") != F.col("alias")))
    return N.first_per(x, ["prompt_id", "term"], [F.desc("popularity"), F.length("alias"), "alias"], 2).select("prompt_id", "term", "alias")


@query("f41_rule_parse", "SELECT id, CASE WHEN id % 4 <> 0 THEN 'use ' || predicate END AS action FROM claims", CLAIMS)
def f41(spark, d):
    raw = F.when(F.col("id") % 4 == 0, "{broken").otherwise(F.to_json(F.struct(F.lit("when").alias("trigger"), F.concat(F.lit("use "), "predicate").alias("action"))))
    return A.claims(spark, d).select("id", L.rule_of(raw).getField("action").alias("action"))


@query("g6_supported_reach", """WITH RECURSIVE c AS (SELECT o_orderkey AS id, (o_orderkey % 101) / 100.0::DOUBLE AS confidence FROM orders), e AS (SELECT a.id AS src, a.id + 1 AS dst, a.confidence AS w FROM c a WHERE a.id IN (SELECT l_orderkey FROM lineitem)), r AS (SELECT id AS node, 1.0::DOUBLE AS weight, 0 AS h FROM c WHERE id % 300 = 0 UNION ALL SELECT e.dst, r.weight * e.w, h + 1 FROM r JOIN e ON r.node = e.src WHERE h < 4 AND r.weight * e.w >= 0.01)
 SELECT node, round(max(weight), 6) AS weight FROM r GROUP BY node""")
def g6(spark, d):
    c = A.claims(spark, d)
    e = c.join(A.citations(spark, d), F.col("id") == F.col("claim_id"), "left_semi").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.col("confidence").alias("weight"))
    return N.reach(e, c.filter("id % 300 = 0").select(F.col("id").alias("node")), 4, 0.01).select("node", F.round("weight", 6).alias("weight"))


@query("g11_invalidated", "WITH n AS (SELECT source, sha256(string_agg(claim_id::VARCHAR, ',' ORDER BY claim_id, locator)) AS h FROM citations GROUP BY source), o AS (SELECT source, sha256(string_agg(claim_id::VARCHAR, ',' ORDER BY claim_id, locator)) AS h FROM citations WHERE NOT (source % 10 = 3 AND locator = 1) GROUP BY source) SELECT o.source FROM o JOIN n USING (source) WHERE o.h <> n.h", CITATIONS)
def g11(spark, d):
    def hashed(x, name):
        ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim_id", "locator"))), lambda v: v.claim_id.cast("string")), ",")
        return x.groupBy("source").agg(F.sha2(ids.cast("binary"), 256).alias(name))

    t = A.citations(spark, d)
    return hashed(t.filter("NOT (source % 10 = 3 AND locator = 1)"), "o").join(hashed(t, "n"), "source").filter("o <> n").select("source")


@query("g13_link_suggestions", "WITH l AS (SELECT DISTINCT claim_id, part FROM citations), p AS (SELECT a.claim_id AS a, b.claim_id AS b, count(*) AS shared FROM l a JOIN l b ON a.part = b.part AND a.claim_id <> b.claim_id GROUP BY ALL) SELECT a, b, shared FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) <= 3", CITATIONS)
def g13(spark, d):
    return X.suggestions(A.citations(spark, d), 3)


@query("g9_eligible_observations", """WITH RECURSIVE s AS (SELECT l_orderkey AS claim_id, l_suppkey AS evidence, l_partkey % 200 AS signature FROM lineitem), u AS (SELECT DISTINCT 1000000 + signature AS x, evidence AS y FROM s), b AS (SELECT x, y FROM u UNION SELECT y, x FROM u),
 r AS (SELECT x AS node, x AS low FROM b UNION SELECT b.y, r.low FROM r JOIN b ON r.node = b.x), c AS (SELECT node, min(low) AS component FROM r GROUP BY node)
 SELECT component, count(DISTINCT claim_id) AS claims, count(DISTINCT evidence) AS evidence, count(DISTINCT signature) AS signatures FROM s JOIN c ON evidence = node GROUP BY component HAVING count(DISTINCT claim_id) >= 3 AND count(DISTINCT evidence) >= 2 AND count(DISTINCT signature) >= 2""")
def g9e(spark, d):
    s = A.citations(spark, d).select("claim_id", F.col("source").alias("evidence"), (F.col("part") % 200).alias("signature"))
    comp = X.components(s.select((F.col("signature") + 1000000).alias("src"), F.col("evidence").alias("dst")).distinct())
    return N.eligible_observations(s, comp)


@query("v2_extractor", "SELECT id, CASE WHEN regexp_matches(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b') THEN 'ip_address' END AS predicate, length(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS n FROM notes WHERE status = 'candidate'", NOTES)
def v2(spark, d):
    x = A.notes(spark, d).filter("status = 'candidate'")
    return x.select("id", F.when(T.structure(F.col("text")).getField("predicate") == "ip_address", "ip_address").alias("predicate"), F.length(T.normalised(F.col("text"))).alias("n"))


@query("v3_near_dup_archive", """WITH s AS (SELECT id, scope, status, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS s FROM notes), p AS (SELECT a.id, b.id AS of, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS n, len(b.s) AS m, a.status FROM s a JOIN s b ON a.scope = b.scope AND a.id > b.id AND least(len(a.s), len(b.s)) >= 0.85 * greatest(len(a.s), len(b.s)) WHERE len(a.s) > 0 AND len(b.s) > 0),
 k AS (SELECT * FROM p WHERE i / (n + m - i) >= 0.85 QUALIFY row_number() OVER (PARTITION BY id ORDER BY i / (n + m - i) DESC, of) = 1) SELECT id, of FROM k WHERE status = 'candidate'""", NOTES)
def v3(spark, d):
    n = A.notes(spark, d)
    return S.jaccard_duplicates(n, 0.85, 50).join(n.filter("status = 'candidate'").select("id"), "id", "left_semi").select("id", "of")


@query("v4_deterministic_validation", """WITH x AS (SELECT id, (id % 13)::INT AS k, (id // 13 % 300)::INT AS n FROM claims)
 SELECT id, ok AS valid, CASE WHEN ok THEN [0.10, 0.10, 0.08, 0.10, 0.08, 0.08, 0.06, 0.05, 0.05, 0.08, 0.06, 0.05, 0.04][k + 1] ELSE [-0.35, -0.35, -0.30, -0.35, -0.25, -0.20, -0.25, -0.18, -0.10, -0.18, -0.22, -0.20, -0.10][k + 1] END::DOUBLE AS delta,
 NOT ok AND k NOT IN (7, 8, 12) AS hard_fail FROM (SELECT *, CASE k WHEN 0 THEN n <= 255 WHEN 1 THEN n % 3 < 2 WHEN 2 THEN n % 40 <= 32 WHEN 3 THEN n % 5 <> 0 WHEN 4 THEN n % 4 <> 0 WHEN 5 THEN n % 4 <> 0
 WHEN 6 THEN n * 300 BETWEEN 1 AND 65535 WHEN 7 THEN n % 31 BETWEEN 1 AND 28 WHEN 8 THEN n % 3 < 2 WHEN 9 THEN n % 3 <> 0 WHEN 10 THEN n % 3 <> 0 WHEN 11 THEN n % 3 <> 0 ELSE n % 3 <> 0 END AS ok FROM x)""", CLAIMS)
def v4(spark, d):
    """Values of every format made from the ids; the SQL knows by arithmetic which are valid."""
    n = (F.floor(F.col("id") / 13) % 300).cast("int")
    text = lambda form, *c: F.format_string(form, *(c or (n,)))
    made = (
        ("ip_address", text("10.0.%d.1")),
        ("ipv6", F.when(n % 3 == 0, text("fe80::%x")).when(n % 3 == 1, text("2001:db8:0:0:0:0:0:%x")).otherwise(text("1::2::%x"))),
        ("cidr", text("10.1.2.3/%d", n % 40)),
        ("url", F.when(n % 5 == 0, text("ftp://h%d.org/")).when(n % 5 == 1, text("http://[::%x]:80/a")).otherwise(text("HTTPS://u@h%d.org?q"))),
        ("support_email", F.when(n % 4 == 0, text("a%d@host")).otherwise(text("a.b+%d@mail.org"))),
        ("host", F.when(n % 4 == 0, text("h%d")).otherwise(text("a.h%d.org."))),
        ("port", text("%d", n * 300)),
        ("deadline", text("2001-02-%02d", n % 31)),
        ("semver", F.when(n % 3 == 0, text("1.0.%d")).when(n % 3 == 1, text("v1.2.%d-rc.1")).otherwise(text("1.%d"))),
        ("file_hash", F.when(n % 3 == 0, F.md5(n.cast("string").cast("binary"))).otherwise(F.sha2(n.cast("string").cast("binary"), 256))),
        ("uuid", F.when(n % 3 == 0, text("123e4567-e89b-02d3-a456-%012x")).otherwise(text("123E4567-e89b-42d3-a456-%012x"))),
        ("phone_number", F.when(n % 3 == 0, text("+0 555-000%03d")).otherwise(text("+1 555-000%03d"))),
        ("country_code", F.when(n % 3 == 0, F.lit("x1")).otherwise("uy")),
    )
    pair = F.element_at(F.array(*[F.struct(F.lit(p).alias("predicate"), v.alias("value")) for p, v in made]), (F.col("id") % 13 + 1).cast("int"))
    x = A.claims(spark, d).select("id", pair.alias("p")).select("id", "p.predicate", "p.value")
    return x.select("id", T.validated(F.col("predicate"), F.col("value")).alias("v")).select("id", "v.valid", "v.delta", "v.hard_fail")


@query("v14_proposals", "SELECT claim_id, count(*) AS proposals, max(id) AS last FROM ledger WHERE event_type = 'supersession' GROUP BY claim_id HAVING count(*) >= 2", LEDGER)
def v14(spark, d):
    return A.ledger(spark, d).filter("event_type = 'supersession'").groupBy("claim_id").agg(one().alias("proposals"), F.max("id").alias("last")).filter("proposals >= 2")


@query("v19_erasure", "SELECT id, CASE WHEN subject % 20 = 0 THEN '[REDACTED]' ELSE object_value END AS object_value FROM claims", CLAIMS)
def v19(spark, d):
    return A.claims(spark, d).select("id", F.when(F.col("subject") % 20 == 0, "[REDACTED]").otherwise(F.col("object_value")).alias("object_value"))


@query("v25_idle_sessions", "SELECT claim_id, count(*) AS turns, max(created_at) AS last FROM ledger GROUP BY claim_id HAVING count(*) >= 2 AND max(created_at) <= TIMESTAMP '2024-01-30'", LEDGER)
def v25(spark, d):
    return A.ledger(spark, d).groupBy("claim_id").agg(one().alias("turns"), F.max("created_at").alias("last")).filter((F.col("turns") >= 2) & (F.col("last") <= A.now("2024-01-30 00:00:00")))


@query("r1_task_briefing", "WITH x AS (SELECT scope, id, 10 + id % 20 AS tokens, row_number() OVER (PARTITION BY scope ORDER BY confidence DESC, id) AS r FROM claims WHERE status = 'confirmed'), y AS (SELECT *, sum(tokens) OVER (PARTITION BY scope ORDER BY r) AS running FROM x) SELECT scope, id, running::BIGINT AS running FROM y WHERE running <= 300", CLAIMS)
def r1(spark, d):
    x = A.claims(spark, d).filter("status = 'confirmed'").withColumn("t", 10 + F.col("id") % 20)
    return S.budget_prefix(x, ["scope"], [F.desc("confidence"), "id"], "t", 300).select("scope", "id", "running")


@query("r4_rule_retrieval", "SELECT id, predicate FROM claims WHERE predicate LIKE '%HIGH%' AND status = 'confirmed' ORDER BY confidence DESC, id LIMIT 30", CLAIMS)
def r4(spark, d):
    return A.claims(spark, d).filter(F.col("predicate").contains("HIGH") & (F.col("status") == "confirmed")).orderBy(F.desc("confidence"), "id").limit(30).select("id", "predicate")


@query("r13_insight_floor", "SELECT id, value FROM ledger WHERE value >= 90 AND to_status <> 'archived'", LEDGER)
def r13(spark, d):
    return A.ledger(spark, d).filter("value >= 90 AND to_status <> 'archived'").select("id", "value")


@query("r15_supersession_targets", "SELECT c.id, t.id AS target FROM claims c JOIN claims t ON c.replaced_by = t.id AND c.subject <> t.subject", CLAIMS)
def r15(spark, d):
    c = A.claims(spark, d)
    t = c.select(F.col("id").alias("target"), F.col("subject").alias("s"))
    return c.join(t, (F.col("replaced_by") == F.col("target")) & (F.col("subject") != F.col("s"))).select("id", "target")


@query("r16_claim_links", "SELECT source, count(*) AS links FROM (SELECT claim_id AS a, source FROM citations UNION SELECT part, source FROM citations) GROUP BY source", CITATIONS)
def r16(spark, d):
    t = A.citations(spark, d)
    return t.select(F.col("claim_id").alias("a"), "source").union(t.select(F.col("part").alias("a"), "source")).distinct().groupBy("source").agg(one().alias("links"))


@query("r21_usage_rollup", "SELECT date_trunc('day', created_at) AS day, event_type, count(*) AS n, count(DISTINCT claim_id) AS users FROM ledger GROUP BY 1, 2", LEDGER)
def r21(spark, d):
    return A.ledger(spark, d).groupBy(F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day"), "event_type").agg(one().alias("n"), F.countDistinct("claim_id").alias("users"))


@query("e10_outcome_report", "SELECT raw_type, to_status, count(DISTINCT claim_id) AS claims FROM ledger GROUP BY 1, 2", LEDGER)
def e10(spark, d):
    return A.ledger(spark, d).groupBy("raw_type", "to_status").agg(F.countDistinct("claim_id").alias("claims"))


@query("e11_stage_totals", "SELECT event_type, round(sum(value), 2) AS total, count(*) AS n FROM ledger GROUP BY event_type", LEDGER)
def e11(spark, d):
    return A.ledger(spark, d).groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("total"), one().alias("n"))
