"""Decisions clustered over scopes: same subject, or shared words.

An ordered, greedy grouping has no distributed form; here a cluster is a connected component. Two claims are linked by
the same subject, by two shared words, or by all words of the one that has a single word. Links are never listed as
pairs of claims: a claim meets the least id of each of its word pairs, so a word pair of any number of claims costs a
row for each. A claim's own word pairs grow with the square of its words that others have too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from claimforge.functions import text as T
from claimforge.operators.graph import components
from claimforge.streaming.streams import stored

# Words that do not tell decisions apart.
STOP = (
    "about", "after", "against", "architecture", "because", "claim", "decision", "decisions", "default", "from", "have", "into",
    "must", "project", "should", "that", "the", "their", "this", "uses", "with",
)
EXEMPLARS, NAMED_BY = 5, 4


def decision_words(text, stop: tuple = STOP):
    """Set of words of three characters or more, without dots, dashes and underscores at the ends."""
    words = F.transform(T.all_matches(F.lower(text), "[a-z][a-z0-9+._-]*"), lambda w: F.regexp_replace(w, r"^[._-]+|[._-]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(F.array(*[F.lit(s) for s in stop]), w)))


def decision_links(claims: DataFrame) -> DataFrame:
    """claims(id, subject, words) -> (src, dst): each claim and the least id of every link it is part of."""
    subject = F.lower(F.trim("subject"))
    by_subject = claims.filter(subject != "").select("id", F.concat(F.lit("s:"), subject).alias("node"), F.lit(True).alias("on"))
    w = claims.filter(F.size("words") > 0).select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
    shared = w.groupBy("word").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("word")
    w = stored(w.join(shared, "word"), "decision-words")
    by_word = w.select("id", F.concat(F.lit("1:"), "word").alias("node"), (F.col("n") == 1).alias("on"))
    kept = w.groupBy("id").agg(F.sort_array(F.collect_list("word")).alias("ws"))
    a = kept.select("id", "ws", F.posexplode("ws").alias("i", "x"))
    b = a.select("id", "x", F.explode(F.slice("ws", F.col("i") + 2, F.size("ws"))).alias("y"))
    by_pair = b.select("id", F.concat_ws(" ", F.lit("2:"), "x", "y").alias("node"), F.lit(True).alias("on"))
    nodes = by_subject.union(by_word).union(by_pair)
    low = nodes.groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.max("on").alias("on")).filter("on AND n > 1").select("node", "low")
    return nodes.join(low, "node").filter("id <> low").select(F.col("id").alias("src"), F.col("low").alias("dst")).distinct()


def decision_members(claims: DataFrame) -> DataFrame:
    """claims(id, scope, subject, text) -> (id, cluster, scope, subject, words): the cluster is its least id.

    A claim that nothing links is a cluster of its own; null texts have no words, null and blank subjects link nothing.
    Ids are unique.
    """
    x = stored(claims.select("id", "scope", "subject", F.coalesce(decision_words(F.col("text")), F.array().cast("array<string>")).alias("words")), "decisions")
    found = components(stored(decision_links(x), "decision-links")).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    return x.join(found, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))


def decision_report(members: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` clusters by number of claims, then of scopes, then by the least id: concept, scopes and exemplars.

    The concept is the subject of the first claim that has one, else words of the first claim.
    """
    has = F.trim("subject") != ""
    first_words = F.slice(F.array_sort(F.col("words")), 1, NAMED_BY)
    worded = F.array_join(F.transform(first_words, lambda w: F.when(F.length(w) <= 4, F.upper(w)).otherwise(F.initcap(w))), " + ")
    named = F.when(F.size("words") > 0, worded).otherwise("Uncategorized")
    g = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("claim_count"), F.countDistinct("scope").alias("n_scopes"), F.min(F.when(has, F.struct("id", F.trim("subject").alias("s")))).alias("_s"), F.min(F.struct("id", named.alias("c"))).alias("_c"))
    best = stored(g.orderBy(F.desc("claim_count"), F.desc("n_scopes"), "cluster").limit(top), "decision-report")
    rank = F.row_number().over(W.orderBy(F.desc("claim_count"), F.desc("n_scopes"), "cluster"))  # ``top`` rows
    best = best.select("cluster", rank.alias("rank"), F.coalesce("_s.s", "_c.c").alias("concept"), "claim_count", "n_scopes")
    own = members.join(F.broadcast(best.select("cluster")), "cluster")  # ``top`` rows
    first = own.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy("id"))).filter(F.col("r") <= EXEMPLARS)
    first = first.groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("exemplars"))
    scopes = own.select("cluster", "scope").distinct().groupBy("cluster").agg(F.sort_array(F.collect_list("scope")).alias("scopes"))
    return best.join(scopes, "cluster").join(first, "cluster")
