"""Entities, paths, clusters and rendered contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hop, path): a shortest path to each node reached, the smallest one in order where several are as short."""
    seen = seeds.select("node", F.lit(0).alias("hop"), F.col("node").cast("string").alias("path"))
    front = seen
    for h in range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node"), F.concat_ws(">", "path", F.col("dst").cast("string")).alias("path"))
        front = step.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti").select("node", F.lit(h).alias("hop"), "path")
        seen = seen.union(front)
    return seen


def reach(edges: DataFrame, seeds: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """(node, weight): the best product of edge weights over paths of at most ``depth`` edges; weak ends are cut."""
    best = seeds.select("node", F.lit(1.0).alias("weight"))
    for _ in range(depth):
        e = edges.select("src", "dst", F.col("weight").alias("w"))
        step = best.join(e, best.node == e.src).select(F.col("dst").alias("node"), (F.col("weight") * F.col("w")).alias("weight")).filter(F.col("weight") >= least)
        best = best.unionByName(step).groupBy("node").agg(F.max("weight").alias("weight"))
    return best


def signature(source: Column, relation: str, target: Column, symmetric: bool) -> Column:
    a, b = (F.least(source, target), F.greatest(source, target)) if symmetric else (source, target)
    return F.sha2(F.concat_ws("|", a.cast("string"), F.lit(relation), b.cast("string"), F.lit("v1")).cast("binary"), 256)


def eligible_observations(supports: DataFrame, component: DataFrame) -> DataFrame:
    """Components with three claims, two evidence rows and two signatures or more; upper bounds and hubs are in ``observations``."""
    x = supports.join(component, supports.evidence == component.node)
    g = x.groupBy("component").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("evidence").alias("evidence"), F.countDistinct("signature").alias("signatures"))
    return g.filter("claims >= 3 AND evidence >= 2 AND signatures >= 2")


def resolve_entities(mentions: DataFrame, key: Column) -> DataFrame:
    """One entity per alias key: id by the first mention, all its surface forms counted."""
    x = mentions.withColumn("alias_key", key).filter("alias_key <> ''")
    return x.groupBy("alias_key").agg(F.min("id").alias("entity_id"), F.countDistinct("surface").alias("variants"), F.count(F.lit(1)).alias("mentions"))


def greedy_clusters(pairs: DataFrame) -> DataFrame:
    """Clusters by the smallest direct neighbour: a member joins the smallest id it is similar to, in one aggregate."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    return both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("leader"), F.count(F.lit(1)).alias("neighbours"))


def bundle(frames: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """Ranked frames (id, score) under one roof, each cut to its own budget."""
    out = None
    for name, frame, most in frames:
        part = frame.select(F.lit(name).alias("section"), "id", "score").orderBy(F.desc("score"), "id").limit(most)
        out = part if out is None else out.unionByName(part)
    return out


def rendered(rows: DataFrame) -> DataFrame:
    """A claim as an XML block."""
    return rows.select("id", F.format_string('<claim id="%d" status="%s" confidence="%.2f"/>', "id", "status", "confidence").alias("block"))


def first_per(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("r") <= n).drop("r")
