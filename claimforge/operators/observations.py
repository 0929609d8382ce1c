"""Observations from the graph of episodes: components over shared signatures without hubs, bounds, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimforge.operators.graph import components
from claimforge.streaming.streams import dropped, stored

MAX_HUB_EPISODES = 20
LEAST = {"claims": 3, "evidence": 2, "signatures": 2}
MOST = {"claims": 20, "evidence": 20, "edges": 40}


def hubs(supports: DataFrame, most: int = MAX_HUB_EPISODES) -> DataFrame:
    """(scope, signature, episodes): signatures of more than ``most`` episodes, which tie nothing together."""
    return supports.groupBy("scope", "signature").agg(F.countDistinct("evidence").alias("episodes")).filter(F.col("episodes") > most)


def placed(supports: DataFrame, most_hub: int = MAX_HUB_EPISODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """supports(scope, claim_id, evidence, signature) -> tables of the rows that are no hubs' (scope, label, claim_id, evidence, signature), of
    all episodes (scope, evidence, label, supported), and of components (scope, label, component, episodes, code).

    A signature ties its episodes to the first of them, so n episodes are n edges; a component is named by its least key.
    Rows without a scope or an episode are left out; one without a signature ties and supports nothing.
    """
    s = supports.select("scope", "claim_id", "evidence", "signature").filter("scope IS NOT NULL AND evidence IS NOT NULL")
    s = stored(s.repartition("scope", "evidence").distinct(), "observation-supports")  # dealt by episode: sorted files, and no more shuffles for its rows
    met = s.filter("signature IS NOT NULL").select("scope", "signature", "evidence").distinct()
    held = stored(met.groupBy("scope", "signature").agg(F.count(F.lit(1)).alias("episodes"), F.min("evidence").alias("first")), "observation-signatures")
    hub = stored(held.filter(F.col("episodes") > most_hub).select("scope", "signature"), "observation-hubs")
    episodes = stored(s.select("scope", "evidence").distinct(), "observation-all-episodes")
    rows = stored(s.filter("signature IS NOT NULL").join(hub, ["scope", "signature"], "left_anti").select("scope", "claim_id", "evidence", "signature"), "observation-rows")
    dropped(s, hub)
    first = held.filter(F.col("episodes") <= most_hub).select("scope", "signature", "first")
    edges = rows.select("scope", "signature", "evidence").join(first, ["scope", "signature"]).filter("evidence <> first").select("scope", F.col("evidence").alias("src"), F.col("first").alias("dst"))
    comp = components(edges, within=("scope",)).select("scope", F.col("node").alias("evidence"), F.col("component").alias("label"))
    tied = rows.select("scope", "evidence", F.lit(True).alias("supported"))
    lone = episodes.select("scope", "evidence", F.lit(False).alias("supported"))
    nodes = tied.union(lone).groupBy("scope", "evidence").agg(F.max("supported").alias("supported"))
    nodes = stored(nodes.join(comp, ["scope", "evidence"], "left").select("scope", "evidence", F.coalesce("label", "evidence").alias("label"), "supported"), "observation-episodes")
    name = F.concat_ws("|", F.col("scope").cast("string"), F.lit("e"), F.col("evidence").cast("string"))
    size = nodes.groupBy("scope", "label").agg(F.min(name).alias("component"), F.count(F.lit(1)).alias("episodes"), F.count_if("supported").alias("evidence"))
    at = nodes.select("scope", "evidence", "label")
    labelled = stored(rows.join(at, ["scope", "evidence"]).select("scope", "label", "claim_id", "evidence", "signature"), "observation-members")
    dropped(rows)
    signatures = first.join(at.withColumnRenamed("evidence", "first"), ["scope", "first"]).groupBy("scope", "label").agg(F.count(F.lit(1)).alias("signatures"))
    # A claim may be of many episodes, so its signatures are counted once in the component.
    by_claim = labelled.filter("claim_id IS NOT NULL").select("scope", "label", "claim_id", "signature").distinct().groupBy("scope", "label", "claim_id").agg(F.count(F.lit(1)).alias("edges"))
    claims = by_claim.groupBy("scope", "label").agg(F.count(F.lit(1)).alias("claims"), F.sum("edges").alias("edges"))
    sizes = size.join(signatures, ["scope", "label"], "left").join(claims, ["scope", "label"], "left").na.fill(0, ["signatures", "claims", "edges"])
    few, many = (F.lit(False), F.lit(False))
    for c, n in LEAST.items():
        few = few | (F.col(c) < n)
    for c, n in MOST.items():
        many = many | (F.col(c) > n)
    code = F.when(few, "below_eligibility_threshold").when(many, "component_oversized").otherwise("eligible")
    sizes = stored(sizes.select("scope", "label", "component", "episodes", code.alias("code")), "observation-components")
    dropped(held, episodes)
    return labelled, nodes, sizes


def discover(supports: DataFrame, most_hub: int = MAX_HUB_EPISODES) -> DataFrame:
    """supports(scope, claim_id, evidence, signature) -> members (scope, component, claim_id, evidence, signature, code).

    Episodes that share a signature of at most ``most_hub`` episodes are one component of their scope; rows of hubs tie
    nothing and support nothing. ``code`` is eligible, below_eligibility_threshold or component_oversized; an episode of
    hub rows only is a component below the threshold, with no support left (null claim and signature).
    """
    rows, nodes, sizes = placed(supports, most_hub)
    kind = {f.name: f.dataType for f in rows.schema.fields}
    lone = nodes.filter("NOT supported").select("scope", F.lit(None).cast(kind["claim_id"]).alias("claim_id"), "evidence", F.lit(None).cast(kind["signature"]).alias("signature"), "label")
    every = rows.unionByName(lone)
    return every.join(sizes.drop("episodes"), ["scope", "label"]).select("scope", "component", "claim_id", "evidence", "signature", "code")


def groups(supports: DataFrame, wanted: str, most_hub: int = MAX_HUB_EPISODES) -> DataFrame:
    """(group, claim_id), distinct: the claims of each component of one code, without the rows of all others on the way."""
    rows, _, sizes = placed(supports, most_hub)
    of = sizes.filter(F.col("code") == wanted).select("scope", "label", F.col("component").alias("group"))
    return rows.select("scope", "label", "claim_id").distinct().join(of, ["scope", "label"]).select("group", "claim_id")


def totals(supports: DataFrame, most_hub: int = MAX_HUB_EPISODES) -> DataFrame:
    """(scope, code, components, claims, evidence, hubs): what components of each code hold, and the scope's hubs.

    An episode is of one component, so episodes add up; claims may be of several and are counted once a scope and code.
    """
    s = supports.select("scope", "evidence", "signature").filter("scope IS NOT NULL AND evidence IS NOT NULL AND signature IS NOT NULL")
    n_hubs = hubs(s, most_hub).groupBy("scope").agg(F.count(F.lit(1)).alias("hubs"))
    n_hubs = stored(n_hubs, "observation-hub-counts")
    rows, _, sizes = placed(supports, most_hub)
    base = sizes.groupBy("scope", "code").agg(F.count(F.lit(1)).alias("components"), F.sum("episodes").alias("evidence"))
    coded = sizes.select("scope", "label", "code")
    claims = rows.filter("claim_id IS NOT NULL").select("scope", "label", "claim_id").distinct().join(coded, ["scope", "label"]).select("scope", "code", "claim_id").distinct().groupBy("scope", "code").agg(F.count(F.lit(1)).alias("claims"))
    x = base.join(claims, ["scope", "code"], "left").join(n_hubs, "scope", "left")
    return x.select("scope", "code", "components", F.coalesce("claims", F.lit(0)).alias("claims"), "evidence", F.coalesce("hubs", F.lit(0)).alias("hubs"))


def agreement(found: DataFrame, expected: DataFrame) -> DataFrame:
    """found(group, claim_id) and expected(group, claim_id) -> one row of counts from their overlaps.

    exact: equal sets of claims; missed and extra: groups that meet no group of the other side; split: expected groups over
    two found ones or more; merged: found groups over two expected ones or more. A pair is listed only where groups meet.
    """
    f, e = (stored(x.select(F.col("group").alias(g), "claim_id").distinct(), "agreement-groups") for x, g in ((found, "f"), (expected, "e")))
    nf, ne = f.groupBy("f").agg(F.count(F.lit(1)).alias("nf")), e.groupBy("e").agg(F.count(F.lit(1)).alias("ne"))
    meet = stored(f.join(e, "claim_id").groupBy("f", "e").agg(F.count(F.lit(1)).alias("n")).join(nf, "f").join(ne, "e"), "agreement-meetings")
    exact = meet.agg(F.count_if((F.col("n") == F.col("nf")) & (F.col("n") == F.col("ne"))).alias("exact"))
    by_e = ne.join(meet.groupBy("e").agg(F.count(F.lit(1)).alias("k")), "e", "left").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("k").isNull()).alias("missed"), F.count_if(F.col("k") > 1).alias("split"))
    by_f = nf.join(meet.groupBy("f").agg(F.count(F.lit(1)).alias("k")), "f", "left").agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("k").isNull()).alias("extra"), F.count_if(F.col("k") > 1).alias("merged"))
    x = exact.crossJoin(by_e).crossJoin(by_f)  # three rows of counts
    rate = lambda n: F.when(F.col(n) > 0, F.round(F.col("exact") / F.col(n), 6)).otherwise(1.0)
    return x.withColumn("precision", rate("found")).withColumn("recall", rate("expected"))
