"""Registry of queries with their independent DuckDB SQL, and the shared SQL views of the derived relations."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

CLAIMS = """claims AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS predicate, o_orderstatus AS object_value,
 ['candidate','confirmed','stale','superseded','conflicted','archived'][o_orderkey % 6 + 1] AS status, ['low','medium','high'][o_orderkey % 3 + 1] AS volatility,
 (o_orderkey % 101) / 100.0::DOUBLE AS confidence, o_orderkey % 50 = 0 AS pinned, o_orderdate AS created_at, o_orderdate AS updated_at, o_orderdate AS valid_from,
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + to_days((o_orderkey % 400)::INT) END AS valid_until, o_custkey % 10 AS scope, o_orderkey % 9 AS access_count,
 CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 20)::VARCHAR END AS source_agent, CASE WHEN o_orderkey % 6 = 3 THEN o_orderkey + 1 END AS replaced_by FROM orders)"""
CITATIONS = "citations AS (SELECT l_orderkey AS claim_id, l_suppkey AS source, l_linenumber AS locator, l_partkey AS part, l_shipdate AS created_at FROM lineitem)"
LEDGER = """ledger AS (SELECT event_id AS id, user_id AS claim_id, event_type AS raw_type, ts AS created_at, value, props AS payload,
 CASE event_type WHEN 'view' THEN 'validator' WHEN 'click' THEN 'deterministic_validator' WHEN 'signup' THEN 'ingest' WHEN 'error' THEN 'decay' WHEN 'purchase' THEN 'supersession' END AS event_type,
 ['candidate','confirmed','stale','superseded','conflicted','archived'][(json_extract(props, '$.k'))::INT % 6 + 1] AS from_status,
 ['candidate','confirmed','stale','superseded','conflicted','archived'][((json_extract(props, '$.k'))::INT + 1) % 6 + 1] AS to_status FROM events)"""
NOTES = """notes AS (SELECT d.doc_id AS id, text, lang AS scope, source AS source_agent, CASE quality WHEN 1 THEN 'confirmed' WHEN 0 THEN 'candidate' ELSE 'stale' END AS status,
 CASE WHEN toxic = 1 THEN 'sensitive' ELSE 'public' END AS visibility, (d.doc_id % 101) / 100.0::DOUBLE AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
TURNS = "turns AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, role, text AS content FROM conversations)"
NOW = "TIMESTAMP '2001-09-01 00:00:00'"


def hours(column: str, now: str = NOW) -> str:
    return f"greatest(0.0::DOUBLE, date_diff('second', {column}, {now}) / 3600.0::DOUBLE)"


def query(name: str, sql: str | None = None, *views: str):
    """Registers a query; its SQL gets the named views in a WITH clause."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
            rest = body[len(head) :] if body.upper().startswith(head) else None
            ORACLES[name] = body if not views else head + ", ".join(views) + (", " + rest if rest else " " + body)
        return f

    return add
