"""Retrieval and ranking: lexical and BM25 scores, vectors, rank fusion, gates, caps and budgets."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimforge.functions import text as T
from claimforge.operators.governance import clamp
from claimforge.operators.near import near_pairs
from claimforge.streaming.streams import stored

# Weights of the ranker.
LEXICAL = (0.55, 0.15, 0.25, 0.05)
HYBRID = (0.30, 0.20, 0.10, 0.40)
NO_VECTOR = (0.55, 0.30, 0.15)
PINNED, PENDING = 0.03, -0.40
PROFILES = {"recall": (0.5, 0.2, 0.1, 0.2), "precision": (0.3, 0.5, 0.1, 0.1), "fresh": (0.3, 0.1, 0.5, 0.1), "semantic": (0.2, 0.1, 0.1, 0.6)}
K1, B, RRF_K = 1.2, 0.25, 60


def postings(rows: DataFrame, text: str = "text") -> DataFrame:
    """(id, term, tf, doc_len) over the ranker's raw words; the list is kept for counts, hence no distinct."""
    x = rows.select("id", F.explode(T.all_matches(F.lower(F.col(text)), "[a-z0-9_]{3,}")).alias("term"))
    x = x.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = x.groupBy("id").agg(F.sum("tf").alias("doc_len"))
    return x.join(n, "id")


def bm25(rows: DataFrame, queries: DataFrame, text: str = "text") -> DataFrame:
    """(prompt_id, id, score). Every word is exploded in its task; those outside the queries end at the semi-join, before any shuffle of counts."""
    words = T.all_matches(F.lower(F.col(text)), "[a-z0-9_]{3,}")
    base = rows.select("id", words.alias("w")).filter(F.size("w") > 0).withColumn("doc_len", F.size("w"))
    stats = base.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    q = queries.select("prompt_id", F.explode(T.rank_tokens(F.col("prompt"))).alias("term"))
    terms = q.select("term").distinct()
    tf = base.select("id", "doc_len", F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = tf.join(df, "term").join(F.broadcast(stats))  # one row of corpus statistics
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return x.withColumn("part", part).join(q, "term").groupBy("prompt_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def lexical(query: str, body: Column) -> Column:
    """Weighted token recall, precision, phrase and prefix of one query."""
    q = query.strip().lower()
    wanted = [t for t in dict.fromkeys(re.findall("[a-z0-9_]+", q)) if len(t) >= 3 and t not in T.RANK_STOP]
    have = T.rank_tokens(body)
    hit = F.size(F.array_intersect(have, F.array(*[F.lit(t) for t in wanted]))) if wanted else F.lit(0)
    score = LEXICAL[0] * hit / max(1, len(wanted)) + LEXICAL[1] * hit / F.greatest(F.lit(1), F.size(have)) + F.when(F.lower(body).contains(q), LEXICAL[2]).otherwise(0.0) + F.when(F.exists(have, lambda t: t.startswith(q)), LEXICAL[3]).otherwise(0.0)
    return F.when(F.size(have) > 0, clamp(score)).otherwise(0.0) if wanted else F.lit(0.0)


def top(rows: DataFrame, by: list, order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def rrf(streams: DataFrame, k: int = RRF_K) -> DataFrame:
    """streams(stream, id, rank) -> sum of 1 / (k + rank); streams without an id count nothing for it."""
    return streams.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def component_ranks(rows: DataFrame, components: list[str], by: list[str]) -> DataFrame:
    """A rank column for each component, best first, ties by id."""
    return rows.withColumns({f"{c}_rank": F.row_number().over(W.partitionBy(*by).orderBy(F.desc(c), "id")) for c in components})


def hybrid_rank(rows: DataFrame, floor_ratio: float, limit: int) -> DataFrame:
    """relevance and boosts -> gate of boosts below a share of the best relevance, zero-relevance rows dropped unless pinned."""
    best = rows.agg(F.max("relevance").alias("best"))  # one row, instead of a window that gathers all rows in one task
    gated = (F.col("best") > 0) & (F.col("relevance") < F.col("best") * floor_ratio)
    x = rows.join(F.broadcast(best)).withColumn("gated", gated).filter((F.col("relevance") > 0) | F.col("pinned"))
    x = x.withColumn("final", F.round(F.col("relevance") + F.when(F.col("gated"), 0.0).otherwise(F.col("boosts")), 6))
    return x.orderBy(F.desc("final"), F.desc("confidence"), F.desc("id")).limit(limit)


def diversity(rows: DataFrame, key: str, cap: int, order: list) -> DataFrame:
    """At most ``cap`` rows of a key in rank order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def rrf_tiebreak(rows: DataFrame, by: list[str], components: list[str], threshold: float, head: int = 10) -> DataFrame:
    """Neighbours in the head whose scores differ by no more than the threshold form chains, re-ordered by fusion inside: gaps and islands."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    x = rows.withColumn("pos", F.row_number().over(order))
    gap = F.abs(F.lag("score").over(order) - F.col("score"))
    x = x.withColumn("_new", F.when(gap.isNull() | (gap > threshold + 1e-12) | (F.col("pos") > head), 1).otherwise(0))
    x = x.withColumn("chain", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy(*by, "chain")
    fused = F.lit(0.0)
    for c in components:
        x = x.withColumn(f"_{c}", F.row_number().over(own.orderBy(F.desc(c), "pos")))
        fused = fused + 1.0 / (RRF_K + F.col(f"_{c}"))
    x = x.withColumn("_f", F.round(fused, 12)).withColumn("final_rank", F.min("pos").over(own) + F.row_number().over(own.orderBy(F.desc("_f"), "pos")) - 1)
    return x.drop("_new", "_f", *[f"_{c}" for c in components])


def budget_prefix(rows: DataFrame, by: list[str], order: list, tokens: str, budget: int) -> DataFrame:
    """Rows in order while their running token sum fits; stops at the first that doesn't."""
    w = W.partitionBy(*by).orderBy(*order)
    x = rows.withColumn("running", F.sum(tokens).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.filter(F.col("running") <= budget)


def knapsack(rows: DataFrame, by: list[str], order: str, tokens: str, budget: int) -> DataFrame:
    """Greedy packing that skips rows that don't fit and goes on: a fold over each group's ordered rows."""
    item = F.struct(F.col(order).alias("o"), F.col("id").alias("id"), F.col(tokens).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc.used + x.t <= budget
        return F.struct(F.when(fits, acc.used + x.t).otherwise(acc.used).cast("long").alias("used"), F.when(fits, F.concat(acc.ids, F.array(x.id))).otherwise(acc.ids).alias("ids"))

    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return packed.select(*by, F.aggregate("items", start, step).alias("p")).select(*by, F.col("p.used").alias("used"), F.explode("p.ids").alias("id"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


TILE = 1024


def _tile_products(lo: float, hi: float | None):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, left, right = key
        u = np.array(pdf["v"].tolist(), dtype=float).reshape(len(pdf), -1)
        u /= np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-300)
        ids, tile = pdf["id"].to_numpy(), pdf["tile"].to_numpy()
        x, y = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
        cos = u[x] @ u[y].T
        ok = (cos >= lo) & (cos < hi if hi is not None else True)
        i, j = np.nonzero(ok)
        a, b, c = ids[x[i]], ids[y[j]], cos[i, j]
        once = a < b if left == right else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once], "cos": c[once]})

    return run


def similar_pairs(vectors: DataFrame, lo: float, hi: float | None = None, block: str = "scope") -> DataFrame:
    """Pairs (a < b) inside a block with cosine in [lo, hi), exact: a matrix product for each pair of tiles of about TILE vectors.

    A block of any size is many tiles, so no task holds more than two of them, and only qualified pairs leave a task.
    """
    sizes = vectors.groupBy(F.col(block).alias("blk")).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    x = vectors.select("id", F.col(block).alias("blk"), "v").join(sizes, "blk").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    x = x.select("blk", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "id", "v", "tile")
    kind = vectors.schema["id"].dataType.simpleString()
    return x.groupBy("blk", "t1", "t2").applyInPandas(_tile_products(lo, hi), f"a {kind}, b {kind}, cos double")


def jaccard_duplicates(rows: DataFrame, threshold: float, max_df: int) -> DataFrame:
    """Best earlier near copy by token sets, in the same scope, exactly; the least id of equally near ones. Rows of the same
    set are one class: its least id is the best copy of the others, and only least ids are compared with other sets."""
    x = rows.select("id", "scope", F.array_sort(T.dedupe_tokens(F.col("text"))).alias("s")).filter((F.size("s") > 0) & F.col("scope").isNotNull())
    x = stored(x.withColumn("key", F.sha2(F.concat_ws("\n", F.col("scope").cast("string"), F.array_join("s", " ")), 256)), "duplicate-sets")
    least = stored(x.groupBy("key").agg(F.min("id").alias("of")), "duplicate-classes")
    copies = x.select("id", "key").join(least, "key").filter("id <> of").select("id", "of", F.lit(1.0).alias("jaccard"))
    near = near_pairs(x.join(least.select(F.col("of").alias("id")), "id", "left_semi"), threshold)
    near = near.withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).filter(F.col("jaccard") >= threshold)
    best = top(near.select(F.col("b").alias("id"), F.col("a").alias("of"), "jaccard"), ["id"], [F.desc("jaccard"), "of"], 1)
    return copies.unionByName(best.select("id", "of", F.round("jaccard", 6).alias("jaccard")))
