"""Quality rules: exact document statistics, two fixed rules, and boosted trees over the statistics.

Statistics come from numpy over whole Arrow batches, in one scan without a shuffle. The trees are fitted on the
driver on at most ``train_rows`` labelled rows (those with the smallest id hashes; the bound is a parameter) and
scored as flat node arrays. More symbols, repeated lines or repeated words can only lower a score.

Nulls and ties: a null text has no words, fails the base rule and is dropped; repeated rows are each judged alike;
without labels every document that passes the base rules is kept; labels of unknown documents are ignored; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimforge.llm import gbt
from claimforge.llm.kernel import SPACE, Words, chunks, code_points, mix
from claimforge.llm.training import sampled_texts, smallest

TRAIN_ROWS = 6000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "other_punct_share", "bang_share", "pipe_share", "mean_line", "line_words", "distinct_share", "stop_share")
DIRECTION = np.array([0, 0, -1, -1, -1, 0, 0, 0, -1, 0, 0, 0, 0, 0])

_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[0x0A] = True


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _class(SYMBOLS), _class(bytes(range(65, 91))), _class(b"0123456789")
_PUNCT, _BANG, _PIPE, _STOP = _class(b"-_=+~^@\\/[]{}()'\"`;:"), _class(b"!?"), _class(b"|"), _class(b".,")


def _repeats(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where (doc, key) occurs twice or more."""
    order = np.argsort(mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1))), kind="stable")
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    hit = np.zeros(len(key), dtype=bool)
    hit[:-1] |= same
    hit[1:] |= same
    out = np.zeros(len(key), dtype=bool)
    out[order] = hit
    return out


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Exact counts and the feature matrix, a row for each text."""
    n = len(column)
    counts = {k: np.zeros(n, dtype=np.int64) for k in COUNTS}
    features = np.zeros((n, len(FEATURES)))
    for lo, hi, raw, at in chunks(column):
        docs = hi - lo
        words = Words(raw, at, SPACE)
        cp = code_points(raw)

        def of(table: np.ndarray) -> np.ndarray:
            run = np.zeros(len(raw) + 1, dtype=np.int64)
            np.cumsum(table[raw], out=run[1:])
            return np.diff(run[at])

        chars = np.bincount(words.doc, weights=cp[words.end] - cp[words.start], minlength=docs).astype(np.int64)
        lines = Words(raw, at, _NEWLINE)
        inside = np.searchsorted(words.start, lines.end) - np.searchsorted(words.start, lines.start)
        has = inside > 0
        hashes, line_doc = lines.hashes(lower=False)[has], lines.doc[has]
        order = np.lexsort((hashes, line_doc))
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
        n_lines = np.bincount(line_doc, minlength=docs)
        dup = np.bincount(line_doc[order][again], minlength=docs)
        h = words.hashes(lower=False)
        hit = np.zeros(len(h), dtype=bool)
        if len(h) >= 3:
            tri = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
            own = np.flatnonzero(words.doc[:-2] == words.doc[2:])
            twice = own[_repeats(tri[own], words.doc[own])]
            for j in range(3):
                hit[twice + j] = True
        rep = np.bincount(words.doc[hit], minlength=docs)
        order = np.lexsort((h, words.doc))
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[order][1:] != h[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
        kinds = np.bincount(words.doc[order][first], minlength=docs)
        symbols = of(_SYMBOL)
        for k, v in zip(COUNTS, (words.counts, chars, symbols, dup, rep), strict=True):
            counts[k][lo:hi] = v
        w, c, ln = np.maximum(words.counts, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
        features[lo:hi] = np.stack([np.log1p(words.counts), chars / w, symbols / c, dup / ln, rep / w, of(_UPPER) / c, of(_DIGIT) / c, of(_PUNCT) / c, of(_BANG) / c, of(_PIPE) / w, chars / ln, words.counts / ln, np.log1p(kinds) / np.log1p(w), of(_STOP) / w], axis=1)
    return counts, features


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> gbt.Forest:
    """Boosted trees on the statistics of at most ``train_rows`` labelled documents."""
    from pyspark.sql import functions as F

    ids = smallest(labels.select("doc_id", F.col("quality").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label")), train_rows, F.col("doc_id"))

    def run(it):
        for batch in it:
            _, x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), type=pa.list_(pa.float64()))], ["label", "x"])

    rows = sampled_texts(docs, ids).select("text", F.col("label").cast("long").alias("label")).mapInArrow(run, "label long, x array<double>").toPandas()
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["label"]))  # the sum of a histogram then doesn't depend on the order of arrival
    return gbt.fit(x[order], rows["label"].to_numpy(dtype=float)[order], DIRECTION)


def judge(docs: DataFrame, model: gbt.Forest, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, score and kept."""

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            c, x = statistics(batch.column("text"))
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
            score = model.probability(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c[k]) for k in COUNTS], pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], ["doc_id", *COUNTS, "base_failed", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, score double, kept boolean")
