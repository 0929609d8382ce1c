"""Queries over text claims, prompts, articles and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from claimforge.functions import secrets as K, text as T
from claimforge.operators import claims as C, evaluate as E, ranks as R, search as S
from claimforge.plans.base import NOTES, TURNS, query
from claimforge.sources import adapters as A, text_sources as X

STOP = ",".join(f"'{w}'" for w in T.RANK_STOP)
RANK_TOKENS = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9_]+'), lambda t: length(t) >= 3 AND t NOT IN ({STOP})))"
QUERY_TEXT = "the stupid thing with erly"


@query("p4_visible_claims", "SELECT id, visibility FROM notes WHERE visibility = 'public' OR source_agent = 'src3'", NOTES)
def p4(spark, d):
    return C.visible(A.notes(spark, d), "src3").select("id", "visibility")


@query("p5_federated_allow", "SELECT id, scope FROM notes WHERE scope = 'fr' OR visibility <> 'sensitive'", NOTES)
def p5(spark, d):
    return C.federated(A.notes(spark, d), "fr").select("id", "scope")


@query("p6_root_scope", "SELECT scope, count(*) AS n FROM notes WHERE scope = 'en' GROUP BY scope", NOTES)
def p6(spark, d):
    return A.notes(spark, d).filter(C.scope_covers("en", F.col("scope"))).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


@query("p13_query_class", """SELECT item_id AS prompt_id, CASE WHEN regexp_matches(lower(trim(text)), 'when|last week|yesterday|today|changed|history|timeline|before|after|since') THEN 'temporal'
 WHEN regexp_matches(lower(trim(text)), 'rule|constraint|must|never|always|require|forbidden|policy') THEN 'constraint_check' WHEN regexp_matches(lower(trim(text)), '^(is it|does it|can we|should we|is there|are there|did we|have we)') THEN 'verification'
 WHEN regexp_matches(lower(trim(text)), 'prefer|like|want|style|convention') THEN 'preference' WHEN regexp_matches(lower(trim(text)), 'depends on|calls|uses|imports|related to|connected|linked') THEN 'relational'
 WHEN regexp_matches(lower(trim(text)), '^(what|where|which|who|how many|how much)') THEN 'fact_lookup' ELSE 'open_ended' END AS query_type FROM benchmark""")
def p13(spark, d):
    return A.prompts(spark, d).select("prompt_id", T.query_type(F.col("prompt")).alias("query_type"))


@query("p14_text_class", """SELECT id, CASE WHEN regexp_matches(lower(text), '\\b(don''?t|never|always|stop|instead|prefer|please)\\b') THEN 'preference' WHEN regexp_matches(lower(text), '\\b(decided|decision|we(''ll| will)|let''?s|going to|plan is)\\b') THEN 'decision'
 WHEN regexp_matches(lower(text), '\\b(must|require|rule|constraint|forbidden|mandatory|critical)\\b') THEN 'constraint' WHEN regexp_matches(lower(text), '\\b(using|switched to|migrated|deployed|installed|configured)\\b') THEN 'fact'
 WHEN regexp_matches(lower(text), '\\b(bug|fix|broke|crash|error|issue|problem|wrong)\\b') THEN 'event' WHEN regexp_matches(lower(text), '\\b(todo|will do|next step|action item|need to|should)\\b') THEN 'commitment' END AS kind FROM notes""", NOTES)
def p14(spark, d):
    return A.notes(spark, d).select("id", T.observation_type(F.col("text")).alias("kind"))


@query("p11_keyword_prefilter", "SELECT id, session_id FROM turns WHERE role = 'user' AND (contains(lower(content), 'the') AND contains(lower(content), 'ing'))", TURNS)
def p11(spark, d):
    low = F.lower("content")
    return A.turns(spark, d).filter((F.col("role") == "user") & low.contains("the") & low.contains("ing")).select("id", "session_id")


@query("f1_ranker_tokens", f"SELECT id, len({RANK_TOKENS.format('text')}) AS n_tokens, list_aggregate({RANK_TOKENS.format('text')}, 'min') AS first_token FROM notes", NOTES)
def f1(spark, d):
    t = T.rank_tokens(F.col("text"))
    return A.notes(spark, d).select("id", F.size(t).alias("n_tokens"), F.array_min(t).alias("first_token"))


@query("f3_lexical_score", f"""WITH q AS (SELECT {RANK_TOKENS.format(f"'{QUERY_TEXT}'")} AS w), x AS (SELECT id, text, {RANK_TOKENS.format('text')} AS t, w FROM notes, q)
 SELECT id, round(CASE WHEN len(t) = 0 THEN 0.0 ELSE least(1.0, 0.55::DOUBLE * len(list_intersect(t, w)) / len(w) + 0.15 * len(list_intersect(t, w)) / len(t) + CASE WHEN contains(lower(text), '{QUERY_TEXT}') THEN 0.25 ELSE 0.0 END) END, 6) AS lexical FROM x""", NOTES)
def f3(spark, d):
    return A.notes(spark, d).select("id", F.round(S.lexical(QUERY_TEXT, F.col("text")), 6).alias("lexical"))


BM25 = f"""w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}') AS w FROM notes), base AS (SELECT id, w, len(w) AS doc_len FROM w WHERE len(w) > 0),
 s AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM base), q AS (SELECT item_id AS prompt_id, unnest({RANK_TOKENS.format('text')}) AS term FROM benchmark),
 tf AS (SELECT id, doc_len, term, count(*) AS tf FROM (SELECT id, doc_len, unnest(w) AS term FROM base) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 bm AS (SELECT prompt_id, id, round(sum(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.75::DOUBLE + 0.25::DOUBLE * doc_len / avg_len))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), s GROUP BY ALL)"""


@query("f8_bm25", "SELECT prompt_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 10", NOTES, BM25)
def f8(spark, d):
    return S.top(S.bm25(A.notes(spark, d), A.prompts(spark, d)), ["prompt_id"], [F.desc("score"), "id"], 10).select("prompt_id", "id", "score", "rank")


@query("w5_rrf", """WITH r AS (SELECT prompt_id, bm.id, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, bm.id) AS a, row_number() OVER (PARTITION BY prompt_id ORDER BY confidence DESC, bm.id) AS b FROM bm JOIN notes USING (id))
 SELECT prompt_id, id, round(1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b), 9) AS rrf FROM r WHERE a <= 20""", NOTES, BM25)
def w5(spark, d):
    n = A.notes(spark, d)
    x = S.component_ranks(S.bm25(n, A.prompts(spark, d)).join(n.select("id", "confidence"), "id"), ["score", "confidence"], ["prompt_id"]).filter("score_rank <= 20")
    s = x.select(F.struct("prompt_id", "id").alias("id"), F.explode(F.array("score_rank", "confidence_rank")).alias("rank"))
    return S.rrf(s).select("id.prompt_id", "id.id", F.round("rrf", 9).alias("rrf"))


@query("w4_component_ranks", "SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS score_rank, row_number() OVER (PARTITION BY prompt_id ORDER BY confidence DESC, id) AS confidence_rank FROM bm JOIN notes USING (id) QUALIFY score_rank <= 5 OR confidence_rank <= 5", NOTES, BM25)
def w4(spark, d):
    n = A.notes(spark, d)
    x = S.component_ranks(S.bm25(n, A.prompts(spark, d)).join(n.select("id", "confidence"), "id"), ["score", "confidence"], ["prompt_id"])
    return x.filter("score_rank <= 5 OR confidence_rank <= 5").select("prompt_id", "id", "score_rank", "confidence_rank")


def _hybrid(spark, d):
    """Relevance by BM25 of the first prompt, scaled by the best, and metadata boosts."""
    n = A.notes(spark, d)
    first = A.prompts(spark, d).orderBy("prompt_id").limit(1)
    x = S.bm25(C.visible(n, "src1"), first).select("id", "score")
    y = n.filter("visibility = 'public' OR source_agent = 'src1'").select("id", "confidence", "status", "source_agent", (F.col("id") % 50 == 0).alias("pinned")).join(x, "id", "left")
    return y.select("id", "confidence", "source_agent", "pinned", (F.lit(S.NO_VECTOR[0]) * F.coalesce("score", F.lit(0.0)) / 20.0).alias("relevance"), (F.lit(S.NO_VECTOR[1]) * F.col("confidence") + F.when(F.col("pinned"), S.PINNED).otherwise(0.0) + F.when(F.col("status") == "confirmed", 0.15).otherwise(0.0)).alias("boosts"))


HYBRID = BM25.replace("FROM notes)", "FROM notes WHERE visibility = 'public' OR source_agent = 'src1')").replace("FROM benchmark)", "FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 1))") + """,
 hy AS (SELECT n.id, confidence, source_agent, n.id % 50 = 0 AS pinned, 0.55::DOUBLE * coalesce(score, 0.0) / 20.0 AS relevance, 0.30::DOUBLE * confidence + CASE WHEN n.id % 50 = 0 THEN 0.03 ELSE 0.0 END + CASE WHEN status = 'confirmed' THEN 0.15 ELSE 0.0 END AS boosts FROM notes n LEFT JOIN bm ON n.id = bm.id WHERE visibility = 'public' OR source_agent = 'src1'),
 fin AS (SELECT *, relevance < 0.3::DOUBLE * max(relevance) OVER () AS gated FROM hy), ranked AS (SELECT id, source_agent, confidence, gated, relevance, pinned, round(relevance + CASE WHEN gated THEN 0.0 ELSE boosts END, 6) AS final FROM fin)"""


@query("w2_hybrid_rank", "SELECT id, gated, final FROM ranked WHERE relevance > 0 OR pinned ORDER BY final DESC, confidence DESC, id DESC LIMIT 20", NOTES, HYBRID)
def w2(spark, d):
    return S.hybrid_rank(_hybrid(spark, d), 0.3, 20).select("id", "gated", "final")


@query("w3_diversity_cap", "SELECT id, source_agent, final FROM (SELECT *, row_number() OVER (PARTITION BY source_agent ORDER BY final DESC, id) AS r FROM ranked WHERE relevance > 0) WHERE r <= 3", NOTES, HYBRID)
def w3(spark, d):
    x = S.hybrid_rank(_hybrid(spark, d).filter("relevance > 0"), 0.3, 1 << 30)
    return S.diversity(x, "source_agent", 3, [F.desc("final"), "id"]).select("id", "source_agent", "final")


@query("w20_drop_reasons", "SELECT CASE WHEN relevance = 0 AND NOT pinned THEN 'zero_relevance' WHEN gated THEN 'gated' ELSE 'ranked' END AS reason, count(*) AS n FROM ranked GROUP BY 1", NOTES, HYBRID)
def w20(spark, d):
    x = _hybrid(spark, d)
    best = x.agg(F.max("relevance").alias("best"))  # one row
    x = x.join(F.broadcast(best)).withColumn("gated", F.col("relevance") < F.col("best") * 0.3)
    return x.groupBy(F.when((F.col("relevance") == 0) & ~F.col("pinned"), "zero_relevance").when(F.col("gated"), "gated").otherwise("ranked").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("w1_legacy_rank", f"""WITH q AS (SELECT {RANK_TOKENS.format(f"'{QUERY_TEXT}'")} AS w), x AS (SELECT id, confidence + CASE WHEN id % 50 = 0 THEN 0.03 ELSE 0.0 END AS score, len(list_intersect({RANK_TOKENS.format('text')}, w)) AS hits FROM notes, q WHERE status = 'confirmed')
 SELECT id, hits, round(score, 6) AS score FROM x ORDER BY hits DESC, score DESC, id LIMIT 50""", NOTES)
def w1(spark, d):
    wanted = F.array(*[F.lit(t) for t in ("stupid", "thing", "erly")])
    x = A.notes(spark, d).filter("status = 'confirmed'").select("id", (F.col("confidence") + F.when(F.col("id") % 50 == 0, 0.03).otherwise(0.0)).alias("s"), F.size(F.array_intersect(T.rank_tokens(F.col("text")), wanted)).alias("hits"))
    return x.orderBy(F.desc("hits"), F.desc("s"), "id").limit(50).select("id", "hits", F.round("s", 6).alias("score"))


@query("w8_profile_rank", """SELECT prompt_id, id, round(0.5::DOUBLE * score / 20 + 0.2::DOUBLE * confidence, 9) AS recall, round(0.3::DOUBLE * score / 20 + 0.5::DOUBLE * confidence, 9) AS "precision" FROM bm JOIN notes USING (id) WHERE score > 15""", NOTES, BM25)
def w8(spark, d):
    n = A.notes(spark, d)
    x = S.bm25(n, A.prompts(spark, d)).filter("score > 15").join(n.select("id", "confidence"), "id")
    mix = lambda p: F.round(S.PROFILES[p][0] * F.col("score") / 20 + S.PROFILES[p][1] * F.col("confidence"), 9).alias(p)
    return x.select("prompt_id", "id", mix("recall"), mix("precision"))


@query("w6_rrf_tiebreak", """WITH t AS (SELECT prompt_id, bm.id, score, confidence, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, bm.id) AS pos FROM bm JOIN notes USING (id)), h AS (SELECT * FROM t WHERE pos <= 30),
 g AS (SELECT *, abs(lag(score) OVER (PARTITION BY prompt_id ORDER BY pos) - score) AS gap FROM h), c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 0.5 + 1e-12 OR pos > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY prompt_id ORDER BY pos) AS chain FROM g),
 k AS (SELECT *, round(1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY prompt_id, chain ORDER BY score DESC, pos)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY prompt_id, chain ORDER BY confidence DESC, pos)), 12) AS f FROM c)
 SELECT prompt_id, id, pos, min(pos) OVER (PARTITION BY prompt_id, chain) + row_number() OVER (PARTITION BY prompt_id, chain ORDER BY f DESC, pos) - 1 AS final_rank FROM k""", NOTES, BM25)
def w6(spark, d):
    n = A.notes(spark, d)
    x = S.top(S.bm25(n, A.prompts(spark, d)), ["prompt_id"], [F.desc("score"), "id"], 30).drop("rank").join(n.select("id", "confidence"), "id")
    return S.rrf_tiebreak(x, ["prompt_id"], ["score", "confidence"], 0.5).select("prompt_id", "id", "pos", "final_rank")


@query("u1_and_then_or_fill", """WITH s AS (SELECT id, contains(lower(text), 'stupid') AS a, contains(lower(text), 'idiot') AS b, confidence FROM notes), t AS (SELECT id, CASE WHEN a AND b THEN 1 ELSE 2 END AS tier, confidence FROM s WHERE a OR b)
 SELECT id, tier FROM t ORDER BY tier, confidence DESC, id LIMIT 60""", NOTES)
def u1(spark, d):
    x = A.notes(spark, d).select("id", "confidence", F.lower("text").contains("stupid").alias("a"), F.lower("text").contains("idiot").alias("b"))
    strict, loose = x.filter("a AND b").withColumn("tier", F.lit(1)), x.filter("a OR b").withColumn("tier", F.lit(2))
    return strict.unionByName(loose).groupBy("id").agg(F.min("tier").alias("tier"), F.first("confidence").alias("confidence")).orderBy("tier", F.desc("confidence"), "id").limit(60).select("id", "tier")


@query("u3_multi_stream_union", "SELECT id, max(score) AS score, count(*) AS streams FROM (SELECT id, 1.0::DOUBLE AS score FROM notes WHERE contains(text, 'the') UNION ALL SELECT id, confidence FROM notes WHERE status = 'confirmed' UNION ALL SELECT id, 0.5 FROM notes WHERE scope = 'fr') GROUP BY id", NOTES)
def u3(spark, d):
    n = A.notes(spark, d)
    s = n.filter(F.col("text").contains("the")).select("id", F.lit(1.0).alias("score")).unionByName(n.filter("status = 'confirmed'").select("id", F.col("confidence").alias("score"))).unionByName(n.filter("scope = 'fr'").select("id", F.lit(0.5).alias("score")))
    return s.groupBy("id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("streams"))


@query("a19_ghost_topics", f"""WITH q AS (SELECT item_id, unnest({RANK_TOKENS.format('text')}) AS term FROM benchmark), f AS (SELECT term, count(*) AS freq FROM q GROUP BY term HAVING count(*) >= 3), c AS (SELECT term, count(DISTINCT id) AS claims FROM (SELECT id, unnest({RANK_TOKENS.format('text')}) AS term FROM notes WHERE status = 'confirmed') WHERE term IN (SELECT term FROM f) GROUP BY term)
 SELECT f.term, freq, coalesce(claims, 0) AS claims, freq - coalesce(claims, 0) AS gap FROM f LEFT JOIN c ON f.term = c.term""", NOTES)
def a19(spark, d):
    q = A.prompts(spark, d).select(F.explode(T.rank_tokens(F.col("prompt"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq")).filter("freq >= 3")
    n = A.notes(spark, d).filter("status = 'confirmed'").select(F.explode(T.rank_tokens(F.col("text"))).alias("term")).join(q.select("term"), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("claims"))
    return q.join(n, "term", "left").select("term", "freq", F.coalesce("claims", F.lit(0)).alias("claims"), (F.col("freq") - F.coalesce("claims", F.lit(0))).alias("gap"))


@query("a26_document_frequency", f"SELECT term, count(*) AS df FROM (SELECT unnest({RANK_TOKENS.format('text')}) AS term FROM notes) GROUP BY term HAVING count(*) >= 5", NOTES)
def a26(spark, d):
    return A.notes(spark, d).select(F.explode(T.rank_tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df >= 5")


@query("f10_salient_tokens", f"""WITH t AS (SELECT id, unnest({RANK_TOKENS.format('text')}) AS term FROM notes), df AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM notes), q AS (SELECT item_id AS prompt_id, unnest({RANK_TOKENS.format('text')}) AS term FROM benchmark),
 s AS (SELECT prompt_id, q.term, round(CASE WHEN df IS NULL THEN -8.0::DOUBLE ELSE ln((n + 1.0::DOUBLE) / (df + 1)) + 1 END + CASE WHEN length(q.term) >= 6 THEN 0.1 ELSE 0.0 END, 6) AS salience FROM q LEFT JOIN df ON q.term = df.term, n)
 SELECT prompt_id, term, salience FROM s QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY salience DESC, term) <= 6""", NOTES)
def f10(spark, d):
    n = A.notes(spark, d)
    q = A.prompts(spark, d).select("prompt_id", F.explode(T.rank_tokens(F.col("prompt"))).alias("term"))
    df = n.select(F.explode(T.rank_tokens(F.col("text"))).alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = q.join(df, "term", "left").join(F.broadcast(n.agg(F.count(F.lit(1)).alias("n"))))  # one row
    s = F.when(F.col("df").isNull(), -8.0).otherwise(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1) + F.when(F.length("term") >= 6, 0.1).otherwise(0.0)
    return S.top(x.withColumn("salience", F.round(s, 6)), ["prompt_id"], [F.desc("salience"), "term"], 6).select("prompt_id", "term", "salience")


@query("f16_normalize", "SELECT id, md5(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS digest FROM notes", NOTES)
def f16(spark, d):
    return A.notes(spark, d).select("id", F.md5(T.normalised(F.col("text")).cast("binary")).alias("digest"))


@query("f17_infer_structure", """SELECT id, CASE WHEN regexp_matches(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b') THEN 'infra_fact' WHEN regexp_matches(text, 'https?://[^\\s<>"]+') THEN 'infra_fact' WHEN regexp_matches(text, '(?:^|\\s)(/[A-Za-z0-9._-]+(?:/[A-Za-z0-9._-]+)+)') THEN 'filesystem_fact' WHEN contains(lower(text), 'credential') OR contains(lower(text), 'secret') THEN 'security_fact' END AS claim_type,
 CASE WHEN regexp_matches(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b') THEN regexp_extract(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b', 0) END AS address FROM notes""", NOTES)
def f17(spark, d):
    return A.notes(spark, d).withColumn("s", T.structure(F.col("text"))).select("id", "s.claim_type", F.when(F.col("s.predicate") == "ip_address", F.col("s.value")).alias("address"))


@query("f19_format_validation", """SELECT page_id AS id, regexp_matches(url, '^https?://[^\\s/]+') AS valid, CASE WHEN regexp_matches(url, '^https?://[^\\s/]+') THEN 0.10::DOUBLE ELSE -0.35::DOUBLE END AS delta, NOT regexp_matches(url, '^https?://[^\\s/]+') AS hard_fail FROM pages""")
def f19(spark, d):
    return A.articles(spark, d).select("id", T.validated(F.lit("url"), F.col("slug")).alias("v")).select("id", "v.valid", "v.delta", "v.hard_fail")


@query("f23_claim_redaction", """SELECT id, md5(regexp_replace(regexp_replace(text, '\\b(10\\.\\d{1,3}|192\\.168|172\\.(1[6-9]|2\\d|3[01]))\\.\\d{1,3}\\.\\d{1,3}\\b', '[REDACTED:private_ip]', 'g'),
 '[A-Za-z]:\\\\[^\\s]+|\\\\\\\\[^\\s\\\\]+\\\\[^\\s]+', '[REDACTED:path]', 'g')) AS digest FROM notes""", NOTES)
def f23(spark, d):
    return A.notes(spark, d).select("id", F.md5(T.redact_private(F.col("text")).cast("binary")).alias("digest"))


@query("f24_content_hash", "SELECT id, 'hash-' || substr(sha256(lower(trim(text)) || '|' || scope || '|' || 'default'), 1, 16) AS key FROM notes", NOTES)
def f24(spark, d):
    return A.notes(spark, d).select("id", T.content_key(F.col("text"), F.col("scope"), F.lit("default")).alias("key"))


@query("f26_alias_key", "SELECT id, substr(regexp_replace(regexp_replace(lower(trim(slug)), '[\\s_\\-.]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 200) AS alias FROM (SELECT page_id AS id, url AS slug FROM pages)")
def f26(spark, d):
    return A.articles(spark, d).select("id", T.alias_key(F.col("slug")).alias("alias"))


@query("f28_entities", """SELECT id, kind, surface FROM (SELECT id, 'email' AS kind, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) AS surface FROM notes UNION ALL SELECT id, 'ipv4', unnest(list_distinct(regexp_extract_all(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'))) FROM notes
 UNION ALL SELECT id, 'hex', unnest(list_distinct(regexp_extract_all(text, '\\b[0-9a-f]{32,64}\\b'))) FROM notes UNION ALL SELECT id, 'assignment', unnest(list_distinct(regexp_extract_all(text, '\\b(?:token|api_key|secret)\\s*[:=]\\s*[^\\s,;]+'))) FROM notes UNION ALL SELECT id, 'version', unnest(list_distinct(regexp_extract_all(text, '\\b\\d+\\.\\d+\\.\\d+\\b'))) FROM notes)""", NOTES)
def f28(spark, d):
    return A.notes(spark, d).select("id", F.explode(T.entities(F.col("text"))).alias("e")).select("id", "e.kind", "e.surface")


@query("f29_hex_references", "SELECT id, len(regexp_extract_all(text, '\\b[0-9a-f]{32,}\\b')) AS refs FROM notes WHERE len(regexp_extract_all(text, '\\b[0-9a-f]{32,}\\b')) > 0", NOTES)
def f29(spark, d):
    return A.notes(spark, d).select("id", F.size(T.all_matches(F.col("text"), r"\b[0-9a-f]{32,}\b")).alias("refs")).filter("refs > 0")


@query("f30_closet_terms", "WITH t AS (SELECT page_id AS id, list_distinct(list_transform(list_concat(regexp_extract_all(html, '[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]+'), regexp_extract_all(html, '[A-Za-z]{5,}')), lambda x: lower(x))) AS terms FROM pages) SELECT id, len(terms) AS n_terms FROM t")
def f30(spark, d):
    return A.articles(spark, d).select("id", F.size(T.closet_terms(F.col("html"))).alias("n_terms"))


@query("f14_token_estimate", "SELECT id, greatest(1, length(text) // 4) AS tokens FROM notes", NOTES)
def f14(spark, d):
    return A.notes(spark, d).select("id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"))


@query("j5_near_duplicate_jaccard", """WITH s AS (SELECT id, scope, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS s FROM notes), p AS (SELECT a.id, b.id AS of, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS n, len(b.s) AS m FROM s a JOIN s b ON a.scope = b.scope AND a.id > b.id AND least(len(a.s), len(b.s)) >= 0.85 * greatest(len(a.s), len(b.s)) WHERE len(a.s) > 0 AND len(b.s) > 0)
 SELECT id, of, round(i / (n + m - i), 6) AS jaccard FROM p WHERE i / (n + m - i) >= 0.85 QUALIFY row_number() OVER (PARTITION BY id ORDER BY i / (n + m - i) DESC, of) = 1""", NOTES)
def j5(spark, d):
    return S.jaccard_duplicates(A.notes(spark, d), 0.85, 50)


COS = "v AS (SELECT vec_id AS id, label AS scope, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query("j4_duplicate_pairs", "SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM v a JOIN v b ON a.scope = b.scope AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.4", COS)
def j4(spark, d):
    return S.similar_pairs(A.vectors(spark, d), 0.4).select("a", "b", F.round("cos", 6).alias("cos"))


@query("j6_band_pairs", "SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM v a JOIN v b ON a.scope = b.scope AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.3 AND list_cosine_similarity(a.v, b.v) < 0.4", COS)
def j6(spark, d):
    return S.similar_pairs(A.vectors(spark, d), 0.3, 0.4).select("a", "b", F.round("cos", 6).alias("cos"))


@query("f12_store_cosine", "WITH q AS (SELECT v AS qv FROM v WHERE id = 0) SELECT id, round(greatest(0.0, least(1.0, (list_cosine_similarity(v, qv) + 1) / 2)), 6) AS similarity FROM v, q", COS)
def f12(spark, d):
    x = A.vectors(spark, d)
    q = x.filter("id = 0").select(F.col("v").alias("q"))
    return x.join(F.broadcast(q)).select("id", F.round((S.cosine(F.col("v"), F.col("q")) + 1) / 2, 6).alias("similarity"))  # one row


@query("f6_vector_floor", "WITH q AS (SELECT v AS qv FROM v WHERE id = 0), s AS (SELECT id, (list_cosine_similarity(v, qv) + 1) / 2 AS x FROM v, q) SELECT id, round(CASE WHEN x <= 0.65 THEN 0.0 ELSE (x - 0.65) / 0.35 END, 6) AS above FROM s", COS)
def f6(spark, d):
    x = A.vectors(spark, d)
    s = x.join(F.broadcast(x.filter("id = 0").select(F.col("v").alias("q")))).withColumn("x", (S.cosine(F.col("v"), F.col("q")) + 1) / 2)
    return s.select("id", F.round(F.when(F.col("x") <= 0.65, 0.0).otherwise((F.col("x") - 0.65) / 0.35), 6).alias("above"))


@query("v23_verbatim_dedupe", "SELECT min(doc_id) AS keep, count(*) AS copies FROM documents GROUP BY source, text HAVING count(*) > 1")
def v23(spark, d):
    return A.read(spark, d, "documents").groupBy("source", F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("keep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("keep", "copies")


@query("v8_dedup_archive", """WITH p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.scope = b.scope AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.4) SELECT b AS archived, min(a) AS survivor FROM p GROUP BY b""", COS)
def v8(spark, d):
    return S.similar_pairs(A.vectors(spark, d), 0.4).groupBy(F.col("b").alias("archived")).agg(F.min("a").alias("survivor"))


_RAW_ASKS = "asks AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -(conv_id * 1000 + turn), text FROM conversations)"


@query("v29_action_markers", """WITH m AS (SELECT unnest(['can you', 'could you', 'please', 'pls', 'todo', 'to do', 'remind', 'reminder', 'follow up', 'send', 'pay', 'call', 'check', 'verify', 'quote', 'budget', 'recordame', 'recuerdame', 'mandame', 'enviame', 'pasame', 'pagar', 'llamar', 'presupuesto', 'cotizacion']) AS marker)
 SELECT id, string_agg(marker, ',' ORDER BY marker) AS markers, CASE WHEN bool_or(marker IN ('remind', 'reminder', 'recordame', 'recuerdame')) THEN 'reminder' WHEN bool_or(marker = 'follow up') THEN 'follow_up' ELSE 'task' END AS proposal
 FROM asks, m WHERE contains(lower(text), marker) GROUP BY id""", _RAW_ASKS)
def v29(spark, d):
    turns = A.turns(spark, d).select((-F.col("id")).alias("id"), F.col("content").alias("text"))
    asks = A.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(turns)
    held = asks.select("id", T.action_markers(F.col("text")).alias("m")).filter(F.size("m") > 0)
    any_of = lambda *w: F.arrays_overlap("m", F.array(*[F.lit(x) for x in w]))
    kind = F.when(any_of("remind", "reminder", "recordame", "recuerdame"), "reminder").when(any_of("follow up"), "follow_up").otherwise("task")
    return held.select("id", F.array_join(F.array_sort("m"), ",").alias("markers"), kind.alias("proposal"))


@query("e1_precision_map_at_5", """WITH r AS (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS rank FROM bm), h AS (SELECT prompt_id, rank, status = 'confirmed' AS hit FROM r JOIN notes USING (id) WHERE rank <= 5), c AS (SELECT *, sum(hit::INT) OVER (PARTITION BY prompt_id ORDER BY rank) AS cum FROM h)
 SELECT prompt_id, round(avg(hit::INT), 6) AS precision, round(sum(CASE WHEN hit THEN cum / rank ELSE 0.0 END) / greatest(1, sum(hit::INT)), 6) AS average_precision FROM c GROUP BY prompt_id""", NOTES, BM25)
def e1(spark, d):
    n = A.notes(spark, d)
    r = S.top(S.bm25(n, A.prompts(spark, d)), ["prompt_id"], [F.desc("score"), "id"], 5).join(n.select("id", "status"), "id")
    return E.precision_map(r.select("prompt_id", "rank", (F.col("status") == "confirmed").alias("hit")))


@query("e2_mrr_hit", """WITH r AS (SELECT prompt_id, id, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS rank FROM bm), f AS (SELECT prompt_id, min(rank) FILTER (contains(lower(text), lower(substr((SELECT b.text FROM benchmark b WHERE b.item_id = prompt_id), 1, 60)))) AS first FROM r JOIN notes USING (id) GROUP BY prompt_id)
 SELECT count(*) AS prompts, round(avg(coalesce(1.0::DOUBLE / first, 0.0)), 6) AS mrr, round(avg((coalesce(first, 99) <= 1)::INT), 6) AS hit_at_1, round(avg((coalesce(first, 99) <= 5)::INT), 6) AS hit_at_5 FROM f""", NOTES, BM25)
def e2(spark, d):
    return E.mrr(R.first_hits(A.notes(spark, d), A.prompts(spark, d), 60).select("prompt_id", F.col("first").alias("rank"), F.col("first").isNotNull().alias("hit")))


@query("s6_transcript_turns", "SELECT id, session_id, role, content FROM turns WHERE role IN ('user', 'assistant') AND length(content) >= 20", TURNS)
def s6(spark, d):
    raw = A.turns(spark, d).select("id", "session_id", F.to_json(F.struct(F.struct("role", F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("content")).alias("message"))).alias("line"))
    return X.transcript(raw, "line").select("id", "session_id", "role", "content")


@query("s7_turn_pairs", "SELECT session_id, string_agg(content, chr(10) ORDER BY id) FILTER (role = 'user') AS user_text, string_agg(content, chr(10) ORDER BY id) FILTER (role = 'assistant') AS assistant_text FROM turns GROUP BY session_id", TURNS)
def s7(spark, d):
    rows = A.turns(spark, d).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("id", "role", F.col("content").alias("text")))).alias("e"))
    raw = rows.select("session_id", F.to_json(F.struct(F.transform("e", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("events"))).alias("line"))
    return X.normalised_turns(raw, "line").select("session_id", "user_text", "assistant_text")


@query("s10_html_visible_text")
def s10(spark, d):
    return A.articles(spark, d).select("id", X.visible_text(F.col("html")).alias("text"))


@query("s11_article_front_matter", "SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def s11(spark, d):
    return A.articles(spark, d).select("id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"))


@query("s14_upsert_sources", "SELECT source, text_hash, max(doc_id) AS doc_id FROM (SELECT source, doc_id, md5(text) AS text_hash FROM documents) GROUP BY source, text_hash")
def s14(spark, d):
    return A.read(spark, d, "documents").groupBy("source", F.md5(F.col("text").cast("binary")).alias("text_hash")).agg(F.max("doc_id").alias("doc_id"))


@query("f13_hash_embed")
def f13(spark, d):
    return A.read(spark, d, "documents").select("doc_id", K.embed(F.col("text")).alias("v"))


@query("f21_secret_findings")
def f21(spark, d):
    return A.notes(spark, d).filter(K.may_hold_secret(F.col("text"))).select("id", K.findings(F.col("text")).alias("found")).filter(F.size("found") > 0)


@query("f22_encoded_variants")
def f22(spark, d):
    return A.notes(spark, d).select("id", K.variant_findings(F.col("text")).alias("found"))


@query("f27_fuzzy_alias")
def f27(spark, d):
    a = A.articles(spark, d).select("id", F.regexp_extract("slug", "//([^/]+)", 1).alias("host"))
    return a.select("id", "host", K.fuzzy_ratio(F.col("host"), F.lag("host").over(W.partitionBy(F.length("host")).orderBy("id"))).alias("ratio"))


@query("v21_sensitivity_inventory", "SELECT column_name, count(*) FILTER (regexp_matches(v, '(?i)\\b(token|api[_-]?key|secret)\\s*[:=]\\s*[^\\s,;]+')) AS hits, count(*) AS n FROM (SELECT unnest(['text', 'source']) AS column_name, unnest([text, source]) AS v FROM documents) GROUP BY column_name")
def v21(spark, d):
    x = A.read(spark, d, "documents").select(F.expr("stack(2, 'text', text, 'source', source) AS (column_name, v)"))
    return x.groupBy("column_name").agg(F.count_if(F.col("v").rlike(r"(?i)\b(token|api[_-]?key|secret)\s*[:=]\s*[^\s,;]+")).alias("hits"), F.count(F.lit(1)).alias("n"))
