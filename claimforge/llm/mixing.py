"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Every source's text is a stream of words cut into blocks of ``block_words``. The blocks of the whole mix are
allotted to sources by the highest quotients target / (2 s + 1), then to a source's shards by their lengths,
and each shard takes its quota by seeded systematic selection of blocks. A quota above the number of blocks
repeats blocks; it is at most three times that number, so that no document is taken more than three times.

The highest quotients are found without listing every seat: with D seats and n parties, rounding
target * (D - n) / total gives no more than D seats and rounding target * (D + n) / total no fewer, so only the
quotients between those two lie in doubt (about 2 n rows), and a rank among them settles the rest.

Scale: one scan of the texts; (doc_id, source, size) is written to the shared folder and shuffled, without text. A shard holds about ``shard_words``
words, so a hot source is many shards; windows over sources or shards run on rows that are aggregated already.

Nulls: a null text has size 0 and takes 0 words; a null source is a source of its own, last in order; rows with
null or repeated doc_id are rows like others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from claimforge.llm.io import materialise

WEIGHTS = (5, 2, 1)
BLOCK_WORDS, SHARD_WORDS, REPEATS, SEED = 8, 1 << 20, 3, 20240
#: A prime and a primitive root of it: doc_id -> pseudo-random number, the same in any SQL engine.
PRIME, ROOT = 2147483647, 48271


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def scramble(doc_id: Column, seed: int) -> Column:
    x = F.pmod(F.coalesce(doc_id, F.lit(-1)).cast("long"), F.lit(PRIME)) + F.lit(seed)
    for _ in range(3):
        x = F.pmod(F.pmod(x, F.lit(PRIME)) * F.lit(ROOT) + F.lit(12345), F.lit(PRIME))
    return x


def rounded(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source_key, source_size) -> with target: shares by weight, capped at ``repeats`` sizes, the excess reshared by weight.

    Water-filling in closed form: in ascending order of cap / weight, the capped sources are a prefix; the level
    after k capped ones is (total - their caps) / the other weights, and source k + 1 is capped if its cap is below.
    """
    by_name = W.orderBy(F.col("source_key").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    every = W.partitionBy()
    before = W.orderBy("ratio", F.col("source_key").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    up_to = W.orderBy("ratio", F.col("source_key").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    x = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    x = x.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    x = x.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    x = x.withColumn("capped", F.col("ratio") < F.col("level"))
    x = x.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
    return x.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("level"))).drop("ratio", "cap", "total", "weights", "level", "capped")


def sainte_lague(parties: DataFrame, votes: str, seats: str, group: list[str], key: list[str]) -> DataFrame:
    """Adds ``quota``: the seats of each party in its group by the highest quotients votes / (2 s + 1), ties by key."""
    all_ = W.partitionBy(*group)
    x = parties.withColumn("_n", F.count(F.lit(1)).over(all_)).withColumn("_v", F.sum(F.col(votes).cast("double")).over(all_))
    share = F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(0.0)
    x = x.withColumn("_low", F.greatest(F.lit(0), rounded(share * F.greatest(F.col(seats) - F.col("_n"), F.lit(0)))))
    x = x.withColumn("_high", F.greatest(F.col("_low"), rounded(share * (F.col(seats) + F.col("_n"))) + 1))
    x = x.withColumn("_rest", F.col(seats) - F.sum("_low").over(all_))
    doubt = x.filter(F.col(votes) > 0).select(*group, *key, "_rest", F.col(votes).alias("_votes"), F.explode(F.sequence("_low", "_high")).alias("_s"))
    doubt = doubt.withColumn("_q", F.col("_votes") / (2 * F.col("_s") + 1))
    order = [F.col("_q").desc(), *[F.col(k).asc_nulls_last() for k in key], F.col("_s")]
    won = doubt.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter("_r <= _rest").groupBy(*group, *key).agg(F.count(F.lit(1)).alias("_more"))
    on = None
    a, b = x.alias("a"), won.alias("b")
    for c in [*group, *key]:
        test = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        on = test if on is None else on & test
    return a.join(b, on, "left").select("a.*", (F.col("a._low") + F.coalesce("b._more", F.lit(0))).alias("quota")).drop("_n", "_v", "_low", "_high", "_rest")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, repeats: int = REPEATS, seed: int = SEED, carry: tuple = ()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), and ``carry`` columns."""
    base = docs.select("doc_id", F.col("source").alias("source_key"), word_count(F.col("text")).alias("size"), *carry)
    # The counts are wanted three times; the narrow table is written once so that the texts are read once.
    sized = materialise(base.withColumn("_at", scramble(F.col("doc_id"), seed)), "mixing")
    # Shards are fixed by the hash alone; a source of many words uses more of its bits.
    sources = sized.groupBy("source_key").agg(F.sum("size").cast("long").alias("source_size"))
    sources = targets(sources, weights, repeats)
    sources = sources.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(shard_words)))).cast("long")).withColumn("_all", F.lit(0))
    plan = sized.join(sources, sized.source_key.eqNullSafe(sources.source_key), "inner").drop(sources.source_key)
    plan = plan.withColumn("_shard", F.pmod(F.col("_at"), F.col("_shards")))
    shards = plan.groupBy("source_key", "_shard").agg(F.sum("size").alias("_len"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = shards.withColumn("_blocks", F.ceil(F.col("_len") / float(block_words)).cast("long"))
    totals = shards.groupBy("source_key").agg(F.sum("_blocks").alias("_blocks"), F.first("target").alias("target"), F.first("source_size").alias("source_size")).withColumn("_all", F.lit(0))
    totals = totals.withColumn("_seats", rounded(F.sum("source_size").over(W.partitionBy("_all")) / float(block_words)))
    quotas = sainte_lague(totals, "target", "_seats", ["_all"], ["source_key"]).select("source_key", F.least("quota", F.col("_blocks") * repeats).alias("_source_quota"))
    s = shards.alias("s").join(quotas.alias("q"), F.col("s.source_key").eqNullSafe(F.col("q.source_key"))).select("s.*", "q._source_quota")
    s = sainte_lague(s, "_len", "_source_quota", ["source_key"], ["_shard"])
    s = s.withColumn("quota", F.least("quota", F.col("_blocks") * repeats)).withColumn("_start", F.pmod(scramble(F.col("_shard"), seed + 1), F.greatest(F.col("_blocks"), F.lit(1))))
    s = s.select(F.col("source_key").alias("_sk"), F.col("_shard").alias("_ss"), "_blocks", "quota", "_start")
    x = plan.join(s, plan.source_key.eqNullSafe(F.col("_sk")) & (plan._shard == F.col("_ss")))
    stream = W.partitionBy("source_key", "_shard").orderBy("_at", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_end", F.sum("size").over(stream))

    def picks(k: Column) -> Column:
        return F.floor((k * F.col("quota") + F.col("_start")) / F.col("_blocks"))

    def upto(p: Column) -> Column:
        k, rest = F.floor(p / block_words), p % block_words
        return picks(k) * block_words + rest * (picks(k + 1) - picks(k))

    took = F.when((F.col("size") > 0) & (F.col("_blocks") > 0), upto(F.col("_end")) - upto(F.col("_end") - F.col("size"))).otherwise(0).cast("long")
    return x.select("doc_id", "size", "source_size", "target", took.alias("taken"), *carry)
