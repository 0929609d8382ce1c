"""Queries that run a stream to its end; their SQL is the batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.plans.base import query
from claimforge.sources import adapters as A
from claimforge.streaming import leases as Q, streams as T


def _events(spark, d):
    schema = A.read(spark, d, "events").schema
    return T.parquet_stream(spark, f"{d}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("t2_stream_idempotent_ingest", "SELECT key, min(doc_id) AS first_id FROM (SELECT md5(text) AS key, doc_id FROM documents) GROUP BY key")
def t2(spark, d):
    schema = A.read(spark, d, "documents").schema
    x = T.parquet_stream(spark, f"{d}/documents.parquet", schema).select(F.md5(F.col("text").cast("binary")).alias("key"), F.col("doc_id").alias("first_id"))
    return T.ingest(x, "ingest", "first_id")


@query("t4_quarantine_split", "SELECT event_id % 10 = 0 AS quarantined, count(*) AS n FROM events GROUP BY 1")
def t4(spark, d):
    x = _events(spark, d).select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken"), F.col("props"))).otherwise(F.col("props")).alias("line"))
    out = T.drained(T.quarantine(x, "line", "k int").select("event_id", "quarantined"), "quarantine")
    return out.groupBy("quarantined").agg(F.count(F.lit(1)).alias("n"))


@query("t7_tumbling_counts", "SELECT date_trunc('day', ts) AS win, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t7(spark, d):
    x = T.latest(T.tumbling(_events(spark, d), "ts", ["event_type"], "1 day", "2 days"), ["window", "event_type"], "tumbling")
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("win"), "event_type", "n")


@query("t11_sliding_counts", "SELECT win, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS win, event_type FROM events) GROUP BY ALL")
def t11(spark, d):
    x = T.latest(T.sliding(_events(spark, d), "ts", ["event_type"], "2 hours", "1 hour", "2 days"), ["window", "event_type"], "sliding")
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("win"), "event_type", "n")


@query("t8_session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def t8(spark, d):
    x = T.complete(T.sessions(_events(spark, d), "ts", "user_id", "12 hours", "2 days"), "sessions")
    return x.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


@query("t7_closed_windows", """SELECT win, event_type, n FROM (SELECT date_trunc('day', ts) AS win, event_type, count(*) AS n FROM events GROUP BY 1, 2)
 WHERE win + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def t7_closed(spark, d):
    x = T.closed(T.tumbling(_events(spark, d), "ts", ["event_type"], "1 day", "2 days"), "closed")
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("win"), "event_type", "n")


@query("t9_stream_dedupe", "SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source")
def t9(spark, d):
    schema = A.read(spark, d, "documents").schema
    x = T.parquet_stream(spark, f"{d}/documents.parquet", schema).select("source", F.sha2(F.col("text").cast("binary"), 256).alias("h")).dropDuplicates(["source", "h"])
    return T.drained(x, "dedupe").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("t5_lease_transitions", """WITH j AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'leased' ELSE 'queued' END AS status, event_id % 7 AS attempts, ts + INTERVAL 5 MINUTE AS lease_until FROM events)
 SELECT event_id, CASE WHEN status = 'leased' AND lease_until <= TIMESTAMP '2024-01-20' THEN CASE WHEN attempts >= 5 THEN 'blocked' ELSE 'retryable' END ELSE status END AS next_status, CASE WHEN status = 'leased' AND lease_until <= TIMESTAMP '2024-01-20' AND attempts < 5 THEN floor(least(21600, 60 * pow(2, attempts - 1)))::BIGINT END AS wait_seconds FROM j""")
def t5(spark, d):
    j = A.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "leased").otherwise("queued").alias("status"), (F.col("event_id") % 7).alias("attempts"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("lease_until"))
    return T.lease_step(j, A.now("2024-01-20 00:00:00")).select("event_id", "next_status", "wait_seconds")


#: Operations on jobs (users), from events: what a kind of event does to its user's job.
JOBS = """o AS (SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, ts, CASE event_type WHEN 'signup' THEN 'queue' WHEN 'view' THEN 'lease' WHEN 'click' THEN 'lease' WHEN 'error' THEN 'retryable' WHEN 'purchase' THEN CASE WHEN event_id % 16 = 0 THEN 'completed' ELSE 'lease' END END AS op FROM events),
 r AS (SELECT DISTINCT user_id AS job, 0::BIGINT AS rn, NULL::VARCHAR AS status, 0 AS attempts, NULL::TIMESTAMP AS due, NULL::TIMESTAMP AS expires, 0 AS leases, 0 AS expired FROM events UNION ALL
 SELECT job, rn, CASE op WHEN 'queue' THEN coalesce(s, 'pending') WHEN 'lease' THEN CASE WHEN can THEN 'leased' ELSE s END WHEN 'retryable' THEN CASE WHEN s IS NULL THEN NULL WHEN attempts >= 5 THEN 'blocked' ELSE 'retryable' END WHEN 'completed' THEN CASE WHEN s IS NULL THEN NULL ELSE 'completed' END END,
  attempts + (op = 'lease' AND can)::INT, CASE WHEN op = 'lease' AND NOT can OR op = 'queue' THEN u WHEN op = 'retryable' AND s IS NOT NULL AND attempts < 5 THEN ts + to_seconds(least(21600, 60 * pow(2, greatest(0, attempts - 1)))) END,
  CASE WHEN op = 'lease' AND can THEN ts + INTERVAL 5 MINUTE WHEN op IN ('lease', 'queue') AND s = 'leased' THEN expires END, leases + (op = 'lease' AND can)::INT, expired + over::INT
 FROM (SELECT *, s IN ('pending', 'retryable') IS TRUE AND attempts < 5 AND (u IS NULL OR u <= ts) AS can FROM (SELECT o.job, o.rn, o.ts, o.op, r.attempts, r.expires, r.leases, r.expired, (r.status = 'leased' AND r.expires <= o.ts) IS TRUE AS over,
  CASE WHEN r.status = 'leased' AND r.expires <= o.ts THEN CASE WHEN r.attempts >= 5 THEN 'blocked' ELSE 'retryable' END ELSE r.status END AS s, CASE WHEN r.status = 'leased' AND r.expires <= o.ts THEN CASE WHEN r.attempts < 5 THEN r.expires END ELSE r.due END AS u FROM r JOIN o ON o.job = r.job AND o.rn = r.rn + 1)))"""


@query("t5_lease_queue", f"""WITH RECURSIVE {JOBS}, z AS (SELECT *, (status = 'leased' AND expires <= TIMESTAMP '2024-02-01') IS TRUE AS over FROM r WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job ORDER BY rn DESC) = 1)
 SELECT job AS job_id, CASE WHEN over THEN CASE WHEN attempts >= 5 THEN 'blocked' ELSE 'retryable' END ELSE status END AS status, attempts, leases, expired + over::INT AS expired FROM z""")
def t5_queue(spark, d):
    """The stream of operations of all jobs, run to its end: each job's state, leases and expiries."""
    kinds = {"signup": "queue", "view": "lease", "click": "lease", "error": "retryable", "purchase": "lease"}
    op = F.element_at(F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair]), F.col("event_type"))
    done = (F.col("event_type") == "purchase") & (F.col("event_id") % 16 == 0)
    x = _events(spark, d).select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("seq"), F.when(done, "completed").otherwise(op).alias("op"))
    changes = Q.run_queue(x, T.folder(spark, "leases"), T.folder(spark, "leases-state"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    counts = changes.groupBy("job_id").agg(F.count_if(F.col("cause") == "lease").alias("leases"), F.count_if(F.col("cause") == "lease_expired").alias("expired"), F.max_by("status", "place").alias("last"))
    state = Q.jobs(changes, now)
    over = (F.col("last") == "leased") & (F.col("status") != "leased")
    return state.join(counts, "job_id").select("job_id", "status", "attempts", "leases", (F.col("expired") + over.cast("long")).alias("expired"))
