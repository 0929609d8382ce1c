"""The rank of each prompt's first hit under BM25, without a list of all scored pairs.

One scan turns texts into counts of the prompts' words and finds the hits. A second one scores the hits, a third counts for each
prompt the rows that come before its best hit. A task scores a batch of rows against all prompts at once, in memory; only counts
are shuffled. Prompts are given and few: their words reach every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from claimforge.functions import text as T
from claimforge.operators.search import B, K1
from claimforge.streaming.streams import stored

WORD, BATCH = "[a-z0-9_]{3,}", 512


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For every value of all lists the row that it is of, and the values."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


class _Prompts:
    """Prompts' words as numbers; for each word the prompts that ask for it, and those that hold it whole inside of what a hit must contain."""

    def __init__(self, rows: list) -> None:
        self.ids = np.array([r.prompt_id for r in rows])
        self.wanted = [r.wanted for r in rows]
        self.terms = sorted({t for r in rows for t in r.terms or ()})
        at = {t: i for i, t in enumerate(self.terms)}
        # A word between two other characters of the wanted text is a word of every text that contains it.
        inside = [{at[t] for t in re.findall(rf"(?<=[^a-z0-9_])({WORD})(?=[^a-z0-9_])", w or "") if t in at} for w in self.wanted]
        self.need = np.array([len(x) for x in inside])
        self.asks = self._lists([{at[t] for t in r.terms or ()} for r in rows])
        self.holds = self._lists(inside)

    def _lists(self, sets: list[set]) -> tuple[np.ndarray, np.ndarray]:
        """Starts by word, and prompts."""
        pairs = np.array(sorted((t, p) for p, s in enumerate(sets) for t in s), dtype=np.int64).reshape(-1, 2)
        return np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1)), pairs[:, 1]


def _spread(lists: tuple[np.ndarray, np.ndarray], row: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, width: int) -> np.ndarray:
    """(n, width): sums of the weights of a row's words over the prompts of each word."""
    at, prompts = lists
    m = at[code + 1] - at[code]
    i = np.arange(m.sum()) + np.repeat(at[code] - (np.cumsum(m) - m), m)
    return np.bincount(np.repeat(row, m) * width + prompts[i], weights=np.repeat(weight, m), minlength=n * width).reshape(n, width)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, BATCH):
            yield b.slice(i, BATCH)


def first_hits(rows: DataFrame, prompts: DataFrame, wanted_chars: int) -> DataFrame:
    """rows(id, text), prompts(prompt_id, prompt) -> (prompt_id, first): for each prompt that shares a word with a row, the rank of its best
    row that contains the prompt's first characters; null without one. Ranks go by the rounded score, then id."""
    spark = rows.sparkSession
    q = _Prompts(prompts.select("prompt_id", T.rank_tokens(F.col("prompt")).alias("terms"), F.lower(F.substring("prompt", 1, wanted_chars)).alias("wanted")).orderBy("prompt_id").collect())
    kind = rows.schema["id"].dataType.simpleString()
    width = len(q.ids)
    if not width:
        return prompts.select("prompt_id", F.lit(None).cast("long").alias("first"))
    known = spark.sparkContext.broadcast(q)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = known.value
        terms = pa.array(q.terms, pa.string())
        for b in _slices(batches):
            row, words = _flat(b.column("w"))
            code = pc.fill_null(pc.index_in(words, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.bincount(row, minlength=b.num_rows)
            key, tf = np.unique((row * len(terms) + code)[code >= 0], return_counts=True)
            row, code = key // max(1, len(terms)), key % max(1, len(terms))
            may = _spread(q.holds, row, code, np.ones(len(code)), b.num_rows, width) >= q.need
            hits = [[] for _ in range(b.num_rows)]
            body = b.column("body")
            for i, p in zip(*np.nonzero(may), strict=True):
                if q.wanted[p] is not None and q.wanted[p] in body[i].as_py():
                    hits[i].append(int(p))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), lists(code), lists(tf), pa.array(hits, pa.list_(pa.int32()))], ["id", "doc_len", "c", "n", "hits"])

    body = F.lower("text")
    x = rows.select("id", body.alias("body"), T.all_matches(body, WORD).alias("w")).filter(F.size("w") > 0)
    x = stored(x.mapInArrow(counted, f"id {kind}, doc_len long, c array<int>, n array<int>, hits array<int>"), "rank-counts")
    stats = x.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg")).first()
    df = np.zeros(len(q.terms))
    for r in x.select(F.explode("c").alias("c")).groupBy("c").count().collect():  # the prompts' words bound it
        df[r.c] = r["count"]
    idf = spark.sparkContext.broadcast(np.log((stats.n - df + 0.5) / (df + 0.5) + 1))

    def scores(b: pa.RecordBatch) -> np.ndarray:
        row, code = _flat(b.column("c"))
        code, tf = code.to_numpy(zero_copy_only=False), b.column("n").flatten().to_numpy(zero_copy_only=False)
        norm = K1 * (1 - B + B * b.column("doc_len").to_numpy() / stats.avg)
        return np.floor(_spread(known.value.asks, row, code, idf.value[code] * tf * (K1 + 1) / (tf + norm[row]), b.num_rows, width) * 1e6 + 0.5) / 1e6

    def of_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            s, (row, p) = scores(b), _flat(b.column("hits"))
            p = p.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), b.column("id").take(pa.array(row)), pa.array(s[row, p])], ["p", "id", "score"])

    found = x.filter(F.size("hits") > 0).mapInArrow(of_hits, f"p int, id {kind}, score double").filter("score > 0")
    best = found.groupBy("p").agg(F.max_by(F.struct("score", "id"), F.struct("score", -F.col("id"))).alias("b")).collect()  # one row a prompt
    top_score, top_id = np.full(width, np.inf), np.zeros(width, dtype=np.int64)
    for r in best:
        top_score[r.p], top_id[r.p] = r.b.score, r.b.id

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, ahead = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        for b in _slices(batches):
            s, ids = scores(b), b.column("id").to_numpy()[:, None]
            met += (s > 0).sum(axis=0)
            ahead += ((s > top_score) | ((s == top_score) & (ids < top_id))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(met), pa.array(ahead)], ["p", "met", "ahead"])

    n = x.mapInArrow(before, "p int, met long, ahead long").groupBy("p").agg(F.sum("met").alias("met"), F.sum("ahead").alias("ahead")).filter("met > 0")
    of = spark.createDataFrame([(i, int(v), bool(np.isfinite(top_score[i]))) for i, v in enumerate(q.ids)], "p int, prompt_id long, hit boolean")
    return n.join(of, "p").select("prompt_id", F.when(F.col("hit"), F.col("ahead") + 1).alias("first"))
