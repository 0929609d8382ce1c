"""Evaluation: ranking metrics, confusion counts, frontiers and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def precision_map(ranked: DataFrame, k: int = 5) -> DataFrame:
    """ranked(prompt_id, rank, hit): precision over the head that exists, average precision, per prompt."""
    from pyspark.sql import Window as W

    w = W.partitionBy("prompt_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    x = ranked.filter(F.col("rank") <= k).withColumn("cum", F.sum(F.col("hit").cast("int")).over(w))
    x = x.groupBy("prompt_id").agg(F.avg(F.col("hit").cast("double")).alias("precision"), F.sum(F.when(F.col("hit"), F.col("cum") / F.col("rank")).otherwise(0.0)).alias("_ap"), F.sum(F.col("hit").cast("int")).alias("hits"))
    return x.select("prompt_id", F.round("precision", 6).alias("precision"), F.round(F.col("_ap") / F.greatest(F.lit(1), "hits"), 6).alias("average_precision"))


def mrr(ranked: DataFrame) -> DataFrame:
    first = ranked.groupBy("prompt_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return first.agg(F.count(F.lit(1)).alias("prompts"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg((F.coalesce("first", F.lit(99)) <= 1).cast("double")), 6).alias("hit_at_1"), F.round(F.avg((F.coalesce("first", F.lit(99)) <= 5).cast("double")), 6).alias("hit_at_5"))


def confusion(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    x = rows.agg(n(actual & predicted, "tp"), n(~actual & predicted, "fp"), n(actual & ~predicted, "fn"), n(~actual & ~predicted, "tn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    x = x.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return x.withColumn("f1", ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def frontier(points: DataFrame, cost: str, gain: str) -> DataFrame:
    """Points that no other point dominates (cost no higher and gain no lower, one strictly); equal points both stay."""
    q = points.select(F.col(cost).alias("qc"), F.col(gain).alias("qg"))
    better = (F.col("qc") <= F.col(cost)) & (F.col("qg") >= F.col(gain)) & ((F.col("qc") < F.col(cost)) | (F.col("qg") > F.col(gain)))
    return points.join(F.broadcast(q), better, "left_anti")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    mid, half, den = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.round((mid - half) / den, 6), F.round((mid + half) / den, 6)
