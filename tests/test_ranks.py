"""Ranks of first hits against the full list of scored pairs."""

import random

from pyspark.sql import Window as W, functions as F

from claimforge.operators import evaluate as E, ranks as R, search as S


def by_hand(rows, prompts, chars):
    r = S.bm25(rows, prompts).withColumn("rank", F.row_number().over(W.partitionBy("prompt_id").orderBy(F.desc("score"), "id")))
    x = r.join(rows, "id").join(prompts, "prompt_id")
    hit = F.lower("text").contains(F.lower(F.substring("prompt", 1, chars)))
    return {r.prompt_id: r.first for r in x.groupBy("prompt_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first")).collect()}


def test_first_hits_equal_the_full_list(spark):
    rng = random.Random(7)
    words = [f"wörd{i}" if i % 9 == 0 else f"word{i}" for i in range(50)] + ["the", "of"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))) for _ in range(300)]
    prompts = [(2 * k, rng.choice(texts)[rng.randrange(5) :] if k % 2 else " ".join(rng.choices(words, k=12))) for k in range(30)] + [(90, None), (91, ""), (92, "the of"), (93, "nothing here"), (94, "WORD1 word2")]
    for p in list(texts[:20]):
        texts.append(p.upper())  # equal scores go by id
    texts += [None, "", "word1 word2"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    q = spark.createDataFrame(prompts, "prompt_id long, prompt string")
    for chars in (60, 9, 3):
        got = {r.prompt_id: r.first for r in R.first_hits(rows, q, chars).collect()}
        assert got == by_hand(rows, q, chars) and sum(v is not None for v in got.values()) > 8


def test_no_prompts_and_no_rows(spark):
    rows, q = spark.createDataFrame([(1, "some words")], "id long, text string"), spark.createDataFrame([(1, "some words")], "prompt_id long, prompt string")
    for r, p in ((rows.limit(0), q), (rows, q.limit(0))):
        assert R.first_hits(r, p, 60).count() == 0
        assert E.mrr(R.first_hits(r, p, 60).select("prompt_id", F.col("first").alias("rank"), F.col("first").isNotNull().alias("hit"))).first().prompts == 0
