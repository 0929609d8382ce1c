"""Structured Streaming: idempotent ingestion, quarantine, windows with watermarks, dedupe and a lease state machine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared one, or in the warehouse, which executors share too."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/claimforge-streams"
    return f"{at}/{name}-{uuid.uuid4().hex}"


# Spark's own switch: an execution's shuffle files go with its end instead of at some collection of the driver's garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A frame that several branches read, as a table in the shared folder. The shuffles behind it are dropped once it is written."""
    spark = df.sparkSession
    at, before = folder(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once nothing lazy reads them any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        at = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(conf).delete(at, True)


def parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over one Parquet table (a file or a folder of files)."""
    head, _, tail = path.rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{head}/{tail}*")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all available data into a Parquet folder and reads it."""
    spark = stream.sparkSession
    out = folder(spark, name)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", folder(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs an aggregating stream in update mode: a batch writes the groups that it changed, state behind the watermark is
    dropped and later rows for it are too. The result has each group's last state."""
    spark = stream.sparkSession
    out = folder(spark, name)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")  # a batch that is run again replaces its own rows

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", folder(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(f"{spark_schema(stream)}, batch long").parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, "_last.*")


def spark_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def complete(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream over all available data; the last full result of each batch replaces the one before. For
    session windows, which have no update mode; it keeps all state, so the watermark does not act."""
    spark = stream.sparkSession
    out = folder(spark, name)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{n}")
        batch.sparkSession.createDataFrame([(n,)], "n long").write.mode("append").parquet(f"{out}-batches")

    q = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", folder(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{out}-batches").agg(F.max("n")).first()[0]
    return spark.read.schema(stream.schema).parquet(f"{out}/{last}")


def closed(stream: DataFrame, name: str) -> DataFrame:
    """Runs an aggregating stream in append mode: groups that the watermark has passed, each written once."""
    return drained(stream, name)


def ingest(events: DataFrame, name: str, order: str) -> DataFrame:
    """At-least-once input, exactly-once rows: a key's row with the least ``order`` of the first batch that has it. Batches
    anti-join what earlier ones wrote; a batch that is run again replaces its own rows."""
    spark = events.sparkSession
    out = folder(spark, name)
    columns = f"{spark_schema(events)}, batch long"
    spark.createDataFrame([], columns).write.partitionBy("batch").parquet(out)

    def put(batch: DataFrame, n: int) -> None:
        have = batch.sparkSession.read.schema(columns).parquet(out).filter(F.col("batch") < n).select("key")
        rest = [c for c in events.columns if c != "key"]
        first = batch.groupBy("key").agg(F.min_by(F.struct(*rest), order).alias("_first")).select("key", "_first.*")
        first.join(have, "key", "left_anti").select(*events.columns).write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = events.writeStream.foreachBatch(put).option("checkpointLocation", folder(spark, f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(columns).parquet(out).drop("batch")


def quarantine(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed rows and, in the same frame, those that don't parse with their raw line."""
    x = lines.withColumn("_j", F.from_json(column, schema))
    bad = F.col("_j").isNull() | F.forall(F.array(*[F.col(f"_j.{c.split()[0]}").cast("string") for c in schema.split(", ")]), lambda v: v.isNull())
    return x.withColumn("quarantined", bad)


def tumbling(events: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def sliding(events: DataFrame, time: str, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def lease_step(jobs: DataFrame, now) -> DataFrame:
    """One pass of the lease machine: expired leases become retryable with backoff, five attempts block."""
    expired = (F.col("status") == "leased") & (F.col("lease_until") <= now)
    blocked = expired & (F.col("attempts") >= 5)
    wait = F.least(F.lit(21600), F.lit(60) * F.pow(F.lit(2), F.col("attempts") - 1)).cast("long")
    return jobs.withColumn("next_status", F.when(blocked, "blocked").when(expired, "retryable").otherwise(F.col("status"))).withColumn("wait_seconds", F.when(expired & ~blocked, wait))
