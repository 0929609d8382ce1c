"""Shadow admission: a greedy choice in order of priority over near copies, decided in parallel rounds.

A row is redundant if its normal text, and a near copy if its words (Jaccard 0.8 or more), are those of an admitted row
before it; rows without support or confidence are weak; the rest is admitted while the budget lasts. Rows of one word set
are settled as one: only their first strong row can be admitted. Among those, a row is in once every near copy before it
is out, and out once one of them is in, so a round settles many rows and the rounds are as long as the longest chain of
near copies in falling order. The budget then takes the first ones in; it can be applied last, because rows behind the
budget never decide anything before it. Near copies meet on their rarest words (prefix principle), never all with all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimforge.functions import text as T
from claimforge.operators import near as N
from claimforge.streaming.streams import dropped, stored

SIMILAR, LEAST_CONFIDENCE, ROUNDS = 0.8, 0.6, 200


def greedy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id, rank) and edges(a, b) -> the ids (with rank) that a loop in order of (rank, id) would keep, each without a kept neighbour
    before it. A round's state is a table in the shared folder."""
    r = nodes.select("id", F.struct("rank", "id").alias("r"))
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    before = both.join(r.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(r.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
    before = stored(before.filter("rb < ra").select("a", "b"), "greedy-before")  # b comes before a
    state = stored(nodes.select("id", F.lit("open").alias("state")), "greedy-state")
    for _ in range(ROUNDS):
        told = before.join(state.select(F.col("id").alias("b"), F.col("state").alias("sb")), "b").groupBy("a").agg(F.max((F.col("sb") == "in").cast("int")).alias("some_in"), F.max((F.col("sb") == "open").cast("int")).alias("some_open"))
        x = state.join(told, state.id == told.a, "left")
        new = F.when(F.col("state") != "open", F.col("state")).when(F.col("some_in") == 1, "out").when(F.coalesce("some_open", F.lit(0)) == 1, "open").otherwise("in")
        last, state = state, stored(x.select("id", new.alias("state")), "greedy-state")
        dropped(last)
        if state.filter("state = 'open'").isEmpty():
            return nodes.join(state.filter("state = 'in'").select("id"), "id").select("id", "rank")
    raise RuntimeError(f"admission did not settle in {ROUNDS} rounds")


def admit(rows: DataFrame, budget: int) -> DataFrame:
    """rows(id, rank, text, evidence, confidence, subject, predicate, value) -> (id, admitted, reasons) as the loop in order of (rank, id) gives."""
    words = T.all_matches(F.lower(F.coalesce("text", F.lit(""))), "[a-z0-9_]+")
    x = rows.withColumn("w", words).withColumn("norm", F.xxhash64(F.array_join("w", " "))).withColumn("s", F.array_sort(F.array_distinct("w")))
    x = x.withColumn("set_id", F.xxhash64(F.array_join("s", " "))).withColumn("weak", (F.coalesce("evidence", F.lit(0)) <= 0) | (F.coalesce("confidence", F.lit(0.0)) < LEAST_CONFIDENCE))
    # Texts are read once and kept as their set, each set once: rows go on without words.
    first = F.min(F.when(~F.col("weak"), F.struct("rank", "id")))
    sets = stored(x.groupBy(F.col("set_id").alias("id")).agg(first.alias("first"), F.first("s").alias("s")).withColumn("scope", F.lit(0)), "admission-sets")
    strong, worded = sets.filter("first IS NOT NULL"), sets.filter(F.size("s") > 0)
    x = stored(x.select("id", "rank", "subject", "predicate", "value", "norm", "set_id", "weak", (F.size("s") > 0).alias("worded")), "admission-rows")
    h = stored(N.heads(worded, SIMILAR, N.bucket_counts(worded)), "admission-heads")
    tied = h.join(strong.select("id"), "id", "left_semi")
    near = N.candidates(tied.alias("a"), tied.alias("b"), SIMILAR, F.col("a.id") < F.col("b.id"))
    edges = stored(N.verified(near, sets, sets, SIMILAR).select("a", "b"), "admission-edges")
    kept = greedy(strong.select("id", F.col("first").alias("rank")), edges)
    taken = kept.orderBy("rank").limit(budget).select(F.col("id").alias("set_id"), F.col("rank").alias("first"))  # the budget bounds it
    chosen = stored(taken.join(x.select("set_id", "id", "norm"), (F.col("first.id") == x.id) & (taken.set_id == x.set_id)).select(taken.set_id, "first", "norm"), "admission-chosen")
    # The first admitted near copy of each word set, its own included; sets of weak rows meet the admitted ones too.
    near = near_admitted(worded, h, chosen, SIMILAR)
    own = chosen.select("set_id", F.col("first").alias("own"), "norm")
    y = x.join(near, "set_id", "left").join(own.withColumnRenamed("norm", "own_norm"), "set_id", "left")
    at = F.struct("rank", "id")
    admitted = F.coalesce(F.col("own") == at, F.lit(False))
    redundant = F.coalesce((F.col("own") < at) & (F.col("own_norm") == F.col("norm")), F.lit(False))
    copy = F.coalesce(F.col("near") < at, F.lit(False)) | F.coalesce((F.col("own") < at) & F.col("worded"), F.lit(False))
    reason = F.when(redundant, "redundant").when(copy, "near_duplicate")
    y = y.select("id", "subject", "predicate", "value", admitted.alias("admitted"), F.array_compact(F.array(reason, F.when(F.col("weak"), F.lit("weak_support")))).alias("reasons"))
    y = y.withColumn("reasons", F.when(F.col("admitted"), F.array().cast("array<string>")).when(F.size("reasons") == 0, F.array(F.lit("budget_limit"))).otherwise(F.col("reasons")))
    clash = y.filter(F.col("admitted") & (F.coalesce("subject", F.lit("")) != "") & (F.coalesce("predicate", F.lit("")) != "")).groupBy("subject", "predicate").agg((F.countDistinct(F.coalesce("value", F.lit(""))) > 1).alias("clash"))
    z = y.join(clash, ["subject", "predicate"], "left")
    return z.select("id", "admitted", F.when(F.col("admitted") & F.coalesce("clash", F.lit(False)), F.array(F.lit("lifecycle_conflict"))).otherwise(F.col("reasons")).alias("reasons"))


def near_admitted(sets: DataFrame, h: DataFrame, chosen: DataFrame, threshold: float) -> DataFrame:
    """(set_id, near): the first admitted row whose word set is another, near one. ``h``: the heads of all sets; of the admitted
    ones, no more than the budget, a copy is taken to each task."""
    a = chosen.select(F.col("set_id").alias("id"), "first")
    few = h.join(F.broadcast(a.select("id")), "id", "left_semi")
    pairs = N.candidates(h.alias("a"), few.alias("b"), threshold, F.col("a.id") != F.col("b.id"))
    x = N.verified(pairs, sets, sets, threshold).join(a.withColumnRenamed("id", "b"), "b")
    return x.groupBy(F.col("a").alias("set_id")).agg(F.min("first").alias("near"))
