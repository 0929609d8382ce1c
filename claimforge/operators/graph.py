"""Graph operators as iterated joins over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from claimforge.streaming.streams import dropped, stored


def hops(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hop): least number of hops from any seed, by frontier joins against an anti-joined visited set."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select("node", F.lit(0).alias("hop")).distinct()
    front = seen.select("node")
    for h in range(1, depth + 1):
        new = front.join(both, front.node == both.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        seen = seen.union(new.select("node", F.lit(h).alias("hop")))
        front = new
    return seen


def weakest_link(edges: DataFrame, seeds: DataFrame, confidence: DataFrame, depth: int) -> DataFrame:
    """(node, hop, weakest): the best over paths of exactly the least hops of the least confidence on the path."""
    x = seeds.join(confidence, "node").select("node", F.lit(0).alias("hop"), F.col("confidence").alias("weakest"))
    seen, front = x, x
    for h in range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node"), "weakest").join(confidence, "node")
        new = step.groupBy("node").agg(F.max(F.least("weakest", "confidence")).alias("weakest")).join(seen.select("node"), "node", "left_anti")
        front = new.select("node", F.lit(h).alias("hop"), "weakest")
        seen = seen.union(front)
    return seen


def components(edges: DataFrame, rounds: int = 50, within: tuple = ()) -> DataFrame:
    """(node, component): smallest node reachable, by min-label steps with pointer jumps; ``within`` names columns that go with every node,
    as where the same ids are other nodes in another scope. Each round is a table in the shared folder, the one before is deleted."""
    key = list(within)
    sides = lambda u, v: edges.select(*key, F.col(u).alias("u"), F.col(v).alias("v"))
    both = stored(sides("src", "dst").union(sides("dst", "src")).distinct(), "component-edges")
    table = stored(both.groupBy(*key, "u").agg(F.least(F.min("v"), F.first("u")).alias("label")), "component-labels")
    for _ in range(rounds):
        labels = table.select(*key, "u", "label")
        low = both.join(labels.withColumnRenamed("u", "v"), [*key, "v"]).groupBy(*key, "u").agg(F.min("label").alias("low"))
        step = labels.join(low, [*key, "u"]).select(*key, "u", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        up = labels.select(*key, F.col("u").alias("label"), F.col("label").alias("up"))
        new = stored(step.join(up, [*key, "label"], "left").select(*key, "u", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "component-labels")
        dropped(table)
        table = new
        if new.filter("old <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    dropped(both)
    return table.select(*key, F.col("u").alias("node"), F.col("label").alias("component"))


def shared_entity_edges(links: DataFrame, least: int, most: int) -> DataFrame:
    """Claim pairs (a < b) that share an entity of ``least`` to ``most`` claims: hubs are left out, so lists stay short."""
    l = links.select("claim_id", F.col("source").alias("entity")).distinct()
    ok = l.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most)).select("entity")
    x = l.join(ok, "entity")
    a, b = x.alias("a"), x.alias("b")
    return a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.claim_id") < F.col("b.claim_id"))).groupBy(F.col("a.claim_id").alias("src"), F.col("b.claim_id").alias("dst")).agg(F.count(F.lit(1)).alias("shared"))


def suggestions(links: DataFrame, most: int) -> DataFrame:
    """links(claim_id, part) -> (a, b, shared): for each claim the ``most`` others with the most parts in common, then with the least id.

    Pairs that share two parts or more meet in a pair of parts: s common parts give s (s - 1) / 2 of them. Pairs that share
    one part never have to be listed: behind those above, a claim takes the least ids, which the ``most`` + 1 least ids of
    each of its parts hold (it may be one of them itself). So a part of n claims is n rows, a claim of n parts n * n.
    """
    l = stored(links.select("claim_id", "part").filter("claim_id IS NOT NULL AND part IS NOT NULL").distinct(), "suggestion-links")
    a, b = l.alias("a"), l.alias("b")
    two = a.join(b, (F.col("a.claim_id") == F.col("b.claim_id")) & (F.col("a.part") < F.col("b.part"))).select(F.col("a.claim_id").alias("c"), F.col("a.part").alias("p"), F.col("b.part").alias("q"))
    x, y = two.alias("x"), two.alias("y")
    met = x.join(y, (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q")) & (F.col("x.c") != F.col("y.c"))).groupBy(F.col("x.c").alias("a"), F.col("y.c").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    met = met.select("a", "b", ((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("shared"))
    met = met.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("shared"), "b"))).filter(F.col("r") <= most)
    met = stored(met.groupBy("a").agg(F.collect_list(F.struct((-F.col("shared")).alias("s"), "b")).alias("m")), "suggestion-meetings")
    heads = l.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("claim_id"))).filter(F.col("r") <= most + 1)
    heads = stored(heads.groupBy("part").agg(F.collect_list("claim_id").alias("least")), "suggestion-heads")
    one = l.join(heads.filter(F.size("least") > 1), "part").groupBy(F.col("claim_id").alias("a")).agg(F.array_distinct(F.flatten(F.collect_list("least"))).alias("b"))
    none = F.array().cast(met.schema["m"].dataType)
    near = F.coalesce("m", none)
    others = F.transform(F.filter("b", lambda v: (v != F.col("a")) & ~F.exists(near, lambda m: m.b == v)), lambda v: F.struct(F.lit(-1).cast("long").alias("s"), v.alias("b")))
    best = one.join(met, "a", "left").select("a", F.explode(F.slice(F.array_sort(F.concat(near, others)), 1, most)).alias("t"))
    return best.select("a", F.col("t.b").alias("b"), (-F.col("t.s")).alias("shared"))


def hebbian(supports: DataFrame) -> DataFrame:
    """Edge weights: 1.0 for the first support and 0.1 for each further distinct one; endpoints in order."""
    s = supports.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "support")
    return s.groupBy("src", "dst").agg(F.countDistinct("support").alias("supports")).withColumn("weight", F.round(1.0 + 0.1 * (F.col("supports") - 1), 6))
