"""Governed-claims relations derived from the star-schema tables, by integers and fixed rationals only.

Every relation is a lazy projection, so that filters and columns of an operator reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STATUSES = ("candidate", "confirmed", "stale", "superseded", "conflicted", "archived")
VOLATILITY = ("low", "medium", "high")
EVENT_TYPES = {"view": "validator", "click": "deterministic_validator", "signup": "ingest", "error": "decay", "purchase": "supersession"}
NOW_CLAIMS = "2001-09-01 00:00:00"
NOW_EVENTS = "2024-02-01 00:00:00"


def now(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object_value"),
        pick(STATUSES, k % 6).alias("status"), pick(VOLATILITY, k % 3).alias("volatility"), ((k % 101) / F.lit(100.0)).alias("confidence"), (k % 50 == 0).alias("pinned"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("valid_from"),
        F.when(k % 4 != 0, F.col("o_orderdate") + F.make_dt_interval((k % 400).cast("int"))).alias("valid_until"),
        (F.col("o_custkey") % 10).alias("scope"), (k % 9).alias("access_count"),
        F.when(F.col("o_custkey") % 7 != 0, (F.col("o_custkey") % 20).cast("string")).alias("source_agent"),
        F.when(k % 6 == 3, k + 1).alias("replaced_by"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("locator"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("created_at"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for pair in EVENT_TYPES.items() for x in pair])
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("claim_id"), F.element_at(kind, F.col("event_type")).alias("event_type"), F.col("event_type").alias("raw_type"),
        pick(STATUSES, k % 6).alias("from_status"), pick(STATUSES, (k + 1) % 6).alias("to_status"), F.col("ts").alias("created_at"), F.col("value"), F.col("props").alias("payload"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text claims: documents with their labels."""
    d = read(spark, sf_dir, "documents").alias("d")
    labels = read(spark, sf_dir, "labels").alias("l")
    return d.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        F.col("d.doc_id").alias("id"), F.col("d.text").alias("text"), F.col("d.lang").alias("scope"), F.col("d.source").alias("source_agent"),
        F.when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "candidate").otherwise("stale").alias("status"),
        F.when(F.col("toxic") == 1, "sensitive").otherwise("public").alias("visibility"), ((F.col("d.doc_id") % 101) / F.lit(100.0)).alias("confidence"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "role", F.col("text").alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("slug"), F.col("html"))
