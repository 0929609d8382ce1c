"""Lease queue as keyed state with timers: jobs are queued, leased, finished, given back, expired and blocked."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Attempts before a job is blocked, the first and the longest wait, a lease's length, how a job can end.
MAX_ATTEMPTS, FIRST_WAIT, LONGEST_WAIT, LEASE = 5, 60, 21600, 300
FINISHED = ("completed", "cancelled", "blocked", "retryable")
DUE = ("pending", "retryable")

STATE = "status string, attempts int, due timestamp, expires timestamp"
CHANGES = "job_id long, place long, ts timestamp, status string, attempts int, cause string, due timestamp, expires timestamp"


def wait(attempts: int) -> timedelta:
    return timedelta(seconds=min(LONGEST_WAIT, FIRST_WAIT * 2 ** max(0, min(attempts, 20) - 1)))


def expiry(attempts: int, expires: datetime) -> tuple:
    """State after a lease has run out: due at once, or blocked after the last attempt."""
    return ("blocked", attempts, None, None) if attempts >= MAX_ATTEMPTS else ("retryable", attempts, expires, None)


def after(state: tuple | None, ts: datetime, op: str, lease: timedelta) -> tuple | None:
    """State after an operation, or None if it changes nothing."""
    if state is None:
        return ("pending", 0, None, None) if op == "queue" else None
    status, attempts, due, _ = state
    if op == "lease" and status in DUE and attempts < MAX_ATTEMPTS and (due is None or due <= ts):
        return "leased", attempts + 1, None, ts + lease
    if op == "retryable":
        return ("blocked", attempts, None, None) if attempts >= MAX_ATTEMPTS else ("retryable", attempts, ts + wait(attempts), None)
    return (op, attempts, None, None) if op in FINISHED else None


def _utc(value) -> datetime | None:
    """Times as datetimes without a zone, in UTC, whatever Arrow hands over."""
    if value is None or pd.isna(value):
        return None
    value = pd.Timestamp(value)
    return (value.tz_convert("UTC").tz_localize(None) if value.tzinfo else value).to_pydatetime()


def _millis(value: datetime) -> int:
    """Whole milliseconds, rounded up: a timer never fires early."""
    return -int(-value.replace(tzinfo=timezone.utc).timestamp() * 1000 // 1)


def transitions(operations: DataFrame, late: str, lease_seconds: int = LEASE) -> DataFrame:
    """Stream operations(job_id, ts, seq, op) -> one row for each change of a job, with what came of it.

    ``op`` is ``queue``, ``lease`` or one of the ends; others, and those that do not fit the state, change nothing. A
    batch's operations of a job are applied by ``ts``, then ``seq``; over batches as they arrive. A lease that ran out is
    taken back before the next operation, or by a timer once the watermark has passed it; both give the same row. A
    second ``queue`` of a job is ignored. State is one row a job; a batch's operations of one job are held by its task.
    """
    if not 1 <= lease_seconds <= 3600:
        raise ValueError("lease_seconds must be between 1 and 3600")
    lease = timedelta(seconds=lease_seconds)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = None, 0
        if state.exists:
            *held, n = state.get
            now = (held[0], held[1], _utc(held[2]), _utc(held[3]))
        out = []

        def change(ts: datetime, new: tuple, cause: str) -> None:
            nonlocal now, n
            now, n = new, n + 1
            out.append((key[0], n, ts, new[0], new[1], cause, new[2], new[3]))

        if not state.hasTimedOut:
            ops = sorted((_utc(t), s, op) for f in frames for t, s, op in zip(f["ts"], f["seq"], f["op"], strict=True))
            for ts, _, op in ops:
                if now is not None and now[3] is not None and now[3] <= ts:
                    change(now[3], expiry(now[1], now[3]), "lease_expired")
                new = after(now, ts, op, lease)
                if new is not None:
                    change(ts, new, op)
        passed = state.getCurrentWatermarkMs()
        if now is not None and now[3] is not None and _millis(now[3]) <= passed:
            change(now[3], expiry(now[1], now[3]), "lease_expired")
        if now is not None:
            state.update((*now, n))
            if now[3] is not None:
                state.setTimeoutTimestamp(_millis(now[3]))
        yield pd.DataFrame({
            "job_id": pd.Series([r[0] for r in out], dtype="int64"), "place": pd.Series([r[1] for r in out], dtype="int64"), "ts": pd.Series([r[2] for r in out], dtype="datetime64[us]"),
            "status": pd.Series([r[3] for r in out], dtype=object), "attempts": pd.Series([r[4] for r in out], dtype="int32"), "cause": pd.Series([r[5] for r in out], dtype=object),
            "due": pd.Series([r[6] for r in out], dtype="datetime64[us]"), "expires": pd.Series([r[7] for r in out], dtype="datetime64[us]"),
        })

    x = operations.filter("job_id IS NOT NULL AND ts IS NOT NULL").select(F.col("job_id").cast("long").alias("job_id"), "ts", F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce("op", F.lit("")).alias("op"))
    return x.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(run, CHANGES, f"{STATE}, n long", "append", GroupStateTimeout.EventTimeTimeout)


def run_queue(operations: DataFrame, out: str, state: str, late: str = "1 hour", lease_seconds: int = LEASE) -> DataFrame:
    """Applies all available operations and appends the changes below ``out``; a restart goes on from ``state``."""
    spark = operations.sparkSession
    q = transitions(operations, late, lease_seconds).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(CHANGES).parquet(out)


def jobs(changes: DataFrame, now) -> DataFrame:
    """changes -> (job_id, status, attempts, due, expires): each job's last state, with leases taken back that have run out by ``now``."""
    last = changes.groupBy("job_id").agg(F.max_by(F.struct("status", "attempts", "due", "expires"), "place").alias("s")).select("job_id", "s.*")
    over = (F.col("status") == "leased") & (F.col("expires") <= now)
    spent = F.col("attempts") >= MAX_ATTEMPTS
    status = F.when(over & spent, "blocked").when(over, "retryable").otherwise(F.col("status"))
    due = F.when(over & ~spent, F.col("expires")).otherwise(F.col("due"))
    return last.select("job_id", status.alias("status"), "attempts", due.alias("due"), F.when(~over, F.col("expires")).alias("expires"))


def due_jobs(queue: DataFrame, now, limit: int) -> DataFrame:
    """The next jobs that a worker of each stage of queue(job_id, stage, status, attempts, due) may lease, by id, ``limit`` of a stage."""
    due = F.col("status").isin(*DUE) & (F.col("attempts") < MAX_ATTEMPTS) & (F.col("due").isNull() | (F.col("due") <= now))
    return queue.filter(due).withColumn("rank", F.row_number().over(W.partitionBy("stage").orderBy("job_id"))).filter(F.col("rank") <= limit)
