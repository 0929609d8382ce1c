"""Connected components of a link table by alternating min-label steps and pointer jumps, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimforge.llm.io import discard, materialise

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable. Each round is written to the shared folder.

    A round gives a node the smallest label among its own and its neighbours', aggregated before the shuffle so that
    a node with very many links costs no more than its tasks, then follows labels once (label of the label).
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    edges = materialise(both, "cc-edges")
    table = labels = materialise(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).select(F.col("u").alias("node"), "label"), "cc-labels")
    for _ in range(MAX_ROUNDS):
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("label").alias("low"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = materialise(step.join(up, step.label == up["at"], "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "cc-labels")
        discard(table)
        table, labels = new, new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    discard(edges)
    out = labels.withColumnRenamed("label", "component")
    out.written_at = table.written_at
    return out
