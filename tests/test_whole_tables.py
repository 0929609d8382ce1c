"""Queries read their whole tables: brute force on fixtures whose rows lie outside former id subsets."""

import math
import re

import pytest

from claimforge.functions.text import RANK_STOP
from claimforge.plans import catalog


def test_bm25_grid_takes_every_prompt(spark, tmp_path):
    notes = [(i, " ".join(f"w{(i * j) % 7}x" for j in range(1, 4 + i % 5)), "en", "s", 0) for i in range(30)]
    prompts = [(k, f"w{k % 7}x w{(k + 2) % 7}x") for k in range(4, 40, 3)]
    spark.createDataFrame(notes, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(prompts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [re.findall("[a-z0-9_]{3,}", t) for _, t, *_ in notes]
    avg = sum(map(len, docs)) / len(docs)
    got = {(r.k1, r.b): r.mean_best for r in catalog.QUERIES["e5_bm25_grid"](spark, str(tmp_path)).collect()}
    assert len(got) == 6
    for (k1, b), value in got.items():
        best = []
        for _, t in prompts:
            terms = {w for w in re.findall("[a-z0-9_]{3,}", t) if w not in RANK_STOP}
            df = {w: sum(w in d for d in docs) for w in terms}
            scores = [sum(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * d.count(w) * (k1 + 1) / (d.count(w) + k1 * (1 - b + b * len(d) / avg)) for w in terms if w in d) for d in docs]
            best += [max(scores)] if max(scores) > 0 else []
        assert value == pytest.approx(sum(best) / len(best), abs=1e-6)
