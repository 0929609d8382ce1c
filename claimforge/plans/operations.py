"""Operations on state: inbox streams, first-fit summaries, the cycle, and evaluations of observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions import text as T
from claimforge.operators import admission as M, chain as H, clusters as C, cycle as Y, observations as O
from claimforge.plans.base import CITATIONS, CLAIMS, LEDGER, NOW, hours, query
from claimforge.plans.textual import RANK_TOKENS
from claimforge.sources import adapters as A
from claimforge.streaming import inbox as I
from claimforge.streaming.streams import folder

PAIRS = """turn_rows AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant'))"""


def _inbox(spark, d, parts: int) -> str:
    """An inbox folder that Spark fills with one JSON line a turn, and its parts in turn."""
    at = folder(spark, "inbox")
    user = F.when(F.col("role") == "user", F.col("text"))
    line = F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), F.lit("main").alias("thread_id"), F.col("turn").cast("string").alias("turn_id"), user.alias("user_text"), F.when(F.col("role") == "assistant", F.col("text")).alias("assistant_text")))
    x = A.read(spark, d, "conversations").filter(F.col("role").isin("user", "assistant")).select("conv_id", line.alias("value"))
    for i in range(parts):
        x.filter(F.col("conv_id") % parts == i).select("value").write.mode("append").text(at)
        yield at


@query("t1_inbox_tail", f"WITH {PAIRS} SELECT conv_id::VARCHAR AS session_id, count(*) AS n_lines, count(DISTINCT turn) AS n_turns, sum(length(text))::BIGINT AS n_chars FROM turn_rows GROUP BY conv_id")
def t1(spark, d):
    """Two runs over an inbox that grows between them, with one checkpoint: every line once."""
    out, state = folder(spark, "tailed"), folder(spark, "tail-state")
    for at in _inbox(spark, d, 2):
        I.drain(I.tail(spark, at), out, state)
    x = spark.read.schema(f"{I.LINES}, batch int").parquet(out).select(F.from_json("line", I.TURN).alias("j")).select("j.*")
    chars = F.sum(F.length(F.coalesce("user_text", "assistant_text", F.lit("")))).alias("n_chars")
    return x.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("turn_id").alias("n_turns"), chars)


@query("t3_turn_processing", f"""WITH {PAIRS}, k AS (SELECT item_id AS id, ['confirmed', 'stale', 'conflicted', 'archived'][item_id % 4 + 1] AS status, unnest({RANK_TOKENS.format('text')}) AS term FROM benchmark),
 q AS (SELECT conv_id, turn, unnest({RANK_TOKENS.format('text')}) AS term FROM turn_rows WHERE role = 'user'),
 h AS (SELECT conv_id, turn, id, status = 'confirmed' AS firm, count(*) AS shared FROM q JOIN k USING (term) WHERE status <> 'archived' GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, firm ORDER BY shared DESC, id) AS in_firm, row_number() OVER (PARTITION BY conv_id, turn ORDER BY shared DESC, id) AS in_all, bool_or(firm) OVER (PARTITION BY conv_id, turn) AS any_firm FROM h),
 g AS (SELECT conv_id, turn, any_firm, list(id ORDER BY shared DESC, id) AS ids FROM r WHERE CASE WHEN any_firm THEN firm AND in_firm <= 4 ELSE in_all <= 8 END GROUP BY conv_id, turn, any_firm)
 SELECT t.conv_id::VARCHAR || '/main/' || t.turn::VARCHAR AS turn_key, CASE WHEN trim(text) = '' THEN 0 ELSE 1 END::INT AS n_evidence, CASE WHEN any_firm THEN 'tier1' ELSE 'tier2' END AS tier,
  array_to_string(coalesce(ids, []), ',') AS retrieved FROM turn_rows t LEFT JOIN g USING (conv_id, turn)""")
def t3(spark, d):
    """Tiered retrieval and evidence of every turn of a growing inbox."""
    root, state = folder(spark, "turns"), folder(spark, "turn-state")
    status = F.element_at(F.array(*[F.lit(s) for s in ("confirmed", "stale", "conflicted", "archived")]), (F.col("prompt_id") % 4 + 1).cast("int"))
    knowledge = A.prompts(spark, d).select(F.col("prompt_id").alias("id"), status.alias("status"), F.col("prompt").alias("text"), F.lit(True).alias("visible"))
    for at in _inbox(spark, d, 2):
        I.process(I.tail(spark, at), knowledge, root, state)
    return spark.read.parquet(f"{root}/turns").select("turn_key", "n_evidence", "tier", F.array_join(F.transform("retrieved", lambda i: i.cast("string")), ",").alias("retrieved"))


def _vectors(spark, d):
    """Archived claims with a vector (one in eleven without), a scope, and the text of the document of their id."""
    v = A.vectors(spark, d).select("id", "scope", F.when(F.col("id") % 11 != 0, F.col("v")).alias("v"))
    t = A.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("subject"), F.col("lang").alias("value"), "text")
    return v.join(t, "id", "left").withColumn("predicate", F.lit("about"))


@query("g14_first_fit_clusters", None)
def g14_first_fit(spark, d):
    return C.first_fit(_vectors(spark, d), 0.3)


@query("v11_compact_summaries", None)
def v11(spark, d):
    x = _vectors(spark, d)
    cited = A.citations(spark, d).select("claim_id", F.col("source").cast("string").alias("source"), F.col("part").cast("string").alias("locator"))
    out = C.summaries(x, C.first_fit(x, 0.3), cited, lambda b: F.concat(F.lit("Summary of "), F.size(F.split(b, "\n")).cast("string"), F.lit(" claims")), T.redact_private)
    return out.select("scope", "cluster", "part", F.array_join(F.transform("source_ids", lambda i: i.cast("string")), ",").alias("source_ids"), "subject_hint", "summary", F.length("block").alias("block_chars"), "citations")


SUPPORTS = """sup AS (SELECT DISTINCT (l_orderkey // 24) % 7 AS scope, l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS evidence, CASE WHEN l_partkey % 5 = 0 THEN l_partkey % 10 WHEN (l_orderkey // 24) % 7 = 6 THEN 1000 + (l_orderkey // 24) * 8 + l_partkey % 4 ELSE 1004 + (l_orderkey // 4) * 8 + l_partkey % 3 END AS signature FROM lineitem)"""
GROUPS = """hub AS (SELECT scope, signature FROM sup GROUP BY scope, signature HAVING count(DISTINCT evidence) > 20), kept AS (SELECT * FROM sup WHERE (scope, signature) NOT IN (SELECT (scope, signature) FROM hub)),
 link AS (SELECT DISTINCT scope || '|e|' || evidence AS e, scope || '|s|' || signature AS s FROM kept), near AS (SELECT DISTINCT a.e AS x, b.e AS y FROM link a JOIN link b ON a.s = b.s), walk AS (SELECT x AS node, x AS low FROM near UNION SELECT n.y, w.low FROM walk w JOIN near n ON w.node = n.x),
 comp AS (SELECT node, min(low) AS component FROM walk GROUP BY node), placed AS (SELECT k.*, component FROM kept k JOIN comp ON node = scope || '|e|' || evidence),
 lone AS (SELECT DISTINCT scope, NULL::BIGINT AS claim_id, evidence, NULL::BIGINT AS signature, scope || '|e|' || evidence AS component FROM sup WHERE (scope, evidence) NOT IN (SELECT (scope, evidence) FROM kept)), every AS (SELECT scope, claim_id, evidence, signature, component FROM placed UNION ALL SELECT scope, claim_id, evidence, signature, component FROM lone),
 sized AS (SELECT component, count(DISTINCT claim_id) AS claims, count(DISTINCT CASE WHEN claim_id IS NOT NULL THEN evidence END) AS ev, count(DISTINCT signature) AS sigs, count(DISTINCT CASE WHEN claim_id IS NOT NULL THEN (claim_id, signature) END) AS edges FROM every GROUP BY component),
 coded AS (SELECT e.*, CASE WHEN claims < 3 OR ev < 2 OR sigs < 2 THEN 'below_eligibility_threshold' WHEN claims > 20 OR ev > 20 OR edges > 40 THEN 'component_oversized' ELSE 'eligible' END AS code FROM every e JOIN sized USING (component))"""


def _supports(spark, d):
    """Orders are episodes and their lines claims; parts of one kind are hubs, the rest ties orders of close keys."""
    x, k = A.read(spark, d, "lineitem"), F.col("l_orderkey")
    scope = F.floor(k / 24) % 7
    tie = F.when(F.col("l_partkey") % 5 == 0, F.col("l_partkey") % 10).when(scope == 6, 1000 + F.floor(k / 24) * 8 + F.col("l_partkey") % 4).otherwise(1004 + F.floor(k / 4) * 8 + F.col("l_partkey") % 3)
    return x.select(scope.alias("scope"), (k * 10 + F.col("l_linenumber")).alias("claim_id"), k.alias("evidence"), tie.alias("signature"))


@query("g9_bounded_observations", f"WITH RECURSIVE {SUPPORTS}, {GROUPS} SELECT scope, code, count(DISTINCT component) AS components, count(DISTINCT claim_id) AS claims, count(DISTINCT evidence) AS evidence, (SELECT count(*) FROM hub h WHERE h.scope = c.scope) AS hubs FROM coded c GROUP BY scope, code")
def g9_bounded(spark, d):
    return O.totals(_supports(spark, d))


@query("e12_observation_corpus", f"""WITH RECURSIVE {SUPPORTS}, {GROUPS}, f AS (SELECT DISTINCT component AS f, claim_id FROM coded WHERE code = 'eligible'),
 e AS (SELECT DISTINCT CASE WHEN evidence // 4 % 5 = 1 THEN evidence // 2 ELSE 1000000000 + evidence // 4 END AS e, claim_id FROM sup WHERE evidence // 4 % 9 <> 0), nf AS (SELECT f, count(*) AS nf FROM f GROUP BY f), ne AS (SELECT e, count(*) AS ne FROM e GROUP BY e),
 meet AS (SELECT f, e, count(*) AS n FROM f JOIN e USING (claim_id) GROUP BY f, e), m AS (SELECT * FROM meet JOIN nf USING (f) JOIN ne USING (e)), ke AS (SELECT e, count(*) AS k FROM meet GROUP BY e), kf AS (SELECT f, count(*) AS k FROM meet GROUP BY f),
 c AS (SELECT (SELECT count(*) FROM m WHERE n = nf AND n = ne) AS exact, (SELECT count(*) FROM ne) AS expected, (SELECT count(*) FROM ne WHERE e NOT IN (SELECT e FROM ke)) AS missed, (SELECT count(*) FROM ke WHERE k > 1) AS split, (SELECT count(*) FROM nf) AS found, (SELECT count(*) FROM nf WHERE f NOT IN (SELECT f FROM kf)) AS extra, (SELECT count(*) FROM kf WHERE k > 1) AS merged)
 SELECT *, CASE WHEN found > 0 THEN round(exact / found, 6) ELSE 1.0 END AS precision, CASE WHEN expected > 0 THEN round(exact / expected, 6) ELSE 1.0 END AS recall FROM c""")
def e12(spark, d):
    s = _supports(spark, d)
    found = O.groups(s, "eligible")
    four = F.floor(F.col("evidence") / 4)
    expected = s.filter(four % 9 != 0).select(F.when(four % 5 == 1, F.floor(F.col("evidence") / 2)).otherwise(1000000000 + four).alias("group"), "claim_id")
    return O.agreement(found, expected)


def _score(cites: str, value: str, confidence: str) -> str:
    return f"round(greatest(0.0, least(1.0, (0.35::DOUBLE + least({cites} * 0.12::DOUBLE, 0.4) + least((length(predicate) + length({value})) / 240.0::DOUBLE, 0.15) + 0.1) * 0.75 + {confidence} * 0.25)), 6)"


STEPS = f"""c2 AS (SELECT * REPLACE (lower(trim(object_value)) AS value) FROM (SELECT *, NULL::VARCHAR AS value FROM claims)),
 held AS (SELECT subject, predicate, scope, value, min(CASE WHEN status = 'candidate' THEN id END) AS first, bool_or(status = 'confirmed') AS firm FROM c2 GROUP BY ALL),
 c3 AS (SELECT c2.* REPLACE (CASE WHEN status = 'candidate' AND (firm OR first < id) THEN 'archived' ELSE status END AS status, CASE WHEN status = 'candidate' AND (firm OR first < id) THEN {NOW} ELSE updated_at END AS updated_at) FROM c2 JOIN held USING (subject, predicate, scope, value)),
 c4 AS (SELECT * REPLACE (CASE WHEN status = 'candidate' AND value IN ('o', 'p') THEN greatest(0.0, least(1.0, confidence + CASE value WHEN 'o' THEN 0.05::DOUBLE ELSE -0.2::DOUBLE END)) ELSE confidence END AS confidence) FROM c3),
 cites AS (SELECT claim_id, count(*) AS k FROM citations GROUP BY 1), rival AS (SELECT subject, predicate, scope, first(struct_pack(id, object_value, confidence) ORDER BY confidence DESC, updated_at DESC, id DESC) AS r FROM c4 WHERE status = 'confirmed' GROUP BY ALL),
 ladder AS (SELECT c.id, coalesce(k, 0) AS k, {_score('coalesce(k, 0)', 'c.object_value', 'c.confidence')} AS score, (0.35::DOUBLE + least(coalesce(k, 0) * 0.12::DOUBLE, 0.4) + least((length(predicate) + length(c.object_value)) / 240.0::DOUBLE, 0.15) + 0.1) * 0.75 + c.confidence * 0.25 AS raw, r, lower(trim(c.object_value)) = lower(trim(r.object_value)) AS same
  FROM c4 c LEFT JOIN cites ON c.id = claim_id LEFT JOIN rival USING (subject, predicate, scope) WHERE c.status = 'candidate'),
 verdict AS (SELECT id, score, r.id AS rival, CASE WHEN k = 0 OR raw < 0.58 THEN 'pending' WHEN r IS NULL THEN 'confirmed' WHEN same THEN 'archived' WHEN raw <= r.confidence + 0.08 THEN 'conflicted' ELSE 'supersedes' END AS v FROM ladder),
 c5 AS (SELECT c.* REPLACE (CASE WHEN v IN ('confirmed', 'supersedes') THEN 'confirmed' WHEN v IN ('archived', 'conflicted') THEN v WHEN l.rival IS NOT NULL THEN 'superseded' ELSE status END AS status, CASE WHEN v IN ('confirmed', 'supersedes') THEN score ELSE confidence END AS confidence, CASE WHEN v <> 'pending' OR l.rival IS NOT NULL THEN {NOW} ELSE updated_at END AS updated_at)
  FROM c4 c LEFT JOIN verdict USING (id) LEFT JOIN (SELECT DISTINCT rival FROM verdict WHERE v = 'supersedes') l ON c.id = l.rival),
 faded AS (SELECT id, greatest(0.0::DOUBLE, confidence - CASE volatility WHEN 'low' THEN 0.005::DOUBLE WHEN 'medium' THEN 0.02::DOUBLE ELSE 0.05::DOUBLE END * ({hours('updated_at')} / 24.0::DOUBLE)) AS f FROM c5 WHERE status = 'confirmed' AND NOT pinned AND updated_at <= {NOW}),
 c6 AS (SELECT c.* REPLACE (coalesce(f, confidence) AS confidence, CASE WHEN f < 0.35 THEN 'stale' ELSE status END AS status) FROM c5 c LEFT JOIN faded USING (id)),
 c8 AS (SELECT * REPLACE (CASE WHEN status IN ('stale', 'superseded', 'conflicted') AND NOT pinned AND updated_at < {NOW} - INTERVAL 730 DAY THEN 'archived' ELSE status END AS status) FROM c6),
 seen AS (SELECT user_id AS id, count(*) AS more FROM events GROUP BY 1), c13 AS (SELECT c.* REPLACE (access_count + coalesce(more, 0) AS access_count) FROM c8 c LEFT JOIN seen USING (id)),
 c14 AS (SELECT *, CASE WHEN access_count > 5 OR {hours('updated_at')} / 24.0 < 7 THEN 'core' WHEN access_count = 0 AND {hours('updated_at')} / 24.0 >= 90 THEN 'peripheral' ELSE 'working' END AS tier FROM c13)"""


def _cycle(spark, d):
    now = A.now(A.NOW_CLAIMS)
    c = A.claims(spark, d)
    tables = {
        "claims": c.withColumn("value", F.lit(None).cast("string")).withColumn("tier", F.lit(None).cast("string")),
        "citations": A.citations(spark, d),
        "edges": A.citations(spark, d).select(F.col("claim_id").alias("src"), F.col("source").alias("dst"), F.lit(1.0).alias("weight"), (F.col("part") % 30).cast("double").alias("days")),
        "spool": A.ledger(spark, d).select("claim_id"),
        "index": c.select("id"),
    }
    store = Y.start(spark, folder(spark, "cycle"), tables)
    Y.run_cycle(store, Y.jobs(now))
    return store


@query("v17_cycle_transitions", f"WITH {STEPS} SELECT step, a AS from_status, b AS to_status, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS step, p.status AS a, q.status AS b FROM {x} p JOIN {y} q USING (id)" for n, x, y in (("dedupe", "c2", "c3"), ("validate", "c4", "c5"), ("decay", "c5", "c6"), ("compact", "c6", "c8"))) + ") WHERE a <> b GROUP BY ALL", CLAIMS, CITATIONS)
def v17_transitions(spark, d):
    store = _cycle(spark, d)
    return store.read(store.last())["transitions"].groupBy("step", "from_status", "to_status").agg(F.count(F.lit(1)).alias("n"))


@query("v17_full_cycle", f"WITH {STEPS} SELECT id, status, round(confidence, 6) AS confidence, access_count, tier FROM c14", CLAIMS, CITATIONS)
def v17(spark, d):
    store = _cycle(spark, d)
    return store.read(store.last())["claims"].select("id", "status", F.round("confidence", 6).alias("confidence"), "access_count", "tier")


@query("v27_greedy_admission", None)
def v27_greedy(spark, d):
    """All public confirmed texts and candidates, best confidence first, within a budget of 400."""
    n = A.notes(spark, d).filter("visibility = 'public'")
    rows = n.select("id", (-F.col("confidence")).alias("rank"), "text", (F.col("id") % 13).alias("evidence"), "confidence", F.col("scope").alias("subject"), F.col("status").alias("predicate"), F.col("source_agent").alias("value"))
    return M.admit(rows, 400).select("id", "admitted", F.array_join("reasons", ",").alias("reasons"))


def _events(spark, d):
    return A.ledger(spark, d).select("id", "claim_id", "event_type", "from_status", "to_status", F.lit(None).cast("string").alias("details"), "payload", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("w18_event_chain", f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY id) AS rn, concat_ws(chr(31), 'sha256-v1', claim_id::VARCHAR, event_type, from_status, to_status, '', replace(payload, ' ', ''), strftime(created_at, '%Y-%m-%d %H:%M:%S')) AS body FROM ledger),
 h AS (SELECT id, claim_id, rn, NULL::VARCHAR AS prev_hash, sha256(body || chr(31)) AS event_hash FROM l WHERE rn = 1 UNION ALL SELECT l.id, l.claim_id, l.rn, h.event_hash, sha256(l.body || chr(31) || h.event_hash) FROM h JOIN l ON l.claim_id = h.claim_id AND l.rn = h.rn + 1)
 SELECT id, claim_id, prev_hash, event_hash FROM h""", LEDGER)
def w18_chain(spark, d):
    return H.build(_events(spark, d)).select("id", "claim_id", "prev_hash", "event_hash")


@query("w18_tampered_chain", """WITH s AS (SELECT id, claim_id, id % 97 = 13 AS edited, id % 101 = 17 AS gone, row_number() OVER (PARTITION BY claim_id ORDER BY id) AS rn FROM ledger), k AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY id) AS position, lag(rn) OVER (PARTITION BY claim_id ORDER BY id) AS before FROM s WHERE NOT gone)
 SELECT claim_id, position, id, 'edited' AS fault FROM k WHERE edited UNION ALL SELECT claim_id, position, id, 'missing' FROM k WHERE rn > 1 AND before IS DISTINCT FROM rn - 1""", LEDGER)
def w18_tampered(spark, d):
    """A stored chain with planted edits and deletions: every fault with its position."""
    at = folder(spark, "chain")
    H.build(_events(spark, d)).write.parquet(at)
    stored = spark.read.parquet(at).filter("id % 101 <> 17").withColumn("payload", F.when(F.col("id") % 97 == 13, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    return H.verify(stored)
