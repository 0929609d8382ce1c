"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection.

Subwords are byte n-grams inside words (with the border before and after), hashed to ``buckets`` rows. Embeddings and
softmax are trained together by stochastic gradient descent in numpy on at most ``train_rows`` labelled texts and
random spans of them (so that short texts are known too). As the average and the softmax are linear, scoring needs
only their product: a row of class scores for each bucket, summed over the whole text. A temperature and a
rejection threshold are fitted on a tenth of the sample that training doesn't see.

Scale: one scan, no shuffle; the model has buckets x classes numbers, whatever the corpus.

Nulls: a null text and one without a letter are ``und`` with score 0; null languages are not learned from; without
labelled rows everything is ``und``; repeated rows are scored alike; empty tables give empty results. Other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.kernel import chunks
from claimforge.llm.training import crc_mod, crc_mod_np, smallest

TRAIN_ROWS, SPANS, BUCKETS, DIM, EPOCHS, SEED = 1600, 3, 4096, 16, 12, 11
GRAMS = (2, 3)
FOLDS, HELD_OUT = 4, 2
ACCEPT_ACCURACY = 0.99
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, dtype=np.uint8)
for _b in range(256):
    if 0x41 <= _b <= 0x5A:
        _FOLD[_b] = _b + 32
    elif 0x61 <= _b <= 0x7A or _b >= 0x80:
        _FOLD[_b] = _b
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_HIGH = np.zeros(256, dtype=bool)
_HIGH[0x80:] = True


def grams(raw: np.ndarray, at: np.ndarray, buckets: int):
    """For each n: (bucket of each n-gram, bounds of the texts among them)."""
    c = _FOLD[raw]
    n = len(c)
    blank = c == 0x20
    last = np.zeros(n + 1, dtype=bool)
    last[at] = True
    for size in GRAMS:
        m = n - size + 1
        if m <= 0:
            yield np.zeros(0, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
            continue
        code = c[:m].astype(np.uint32)
        ok = np.ones(m, dtype=bool)
        for j in range(1, size):
            code = (code << np.uint32(8)) | c[j : j + m]
            ok &= ~last[j : j + m]
            if j < size - 1:
                ok &= ~blank[j : j + m]
        if size == 2:
            ok &= ~(blank[:m] & blank[1 : 1 + m])
        where = np.flatnonzero(ok)
        code = code[where] * np.uint32(2654435761) + np.uint32(size * 40503)
        yield ((code ^ (code >> np.uint32(15))) % np.uint32(buckets)).astype(np.int32), np.searchsorted(where, at)


@dataclass
class Model:
    langs: list
    table: np.ndarray  # buckets x langs, temperature included
    bias: np.ndarray
    accept: float

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Class probabilities of each text."""
        docs = len(at) - 1
        logit, n = np.zeros((docs, len(self.langs))), np.zeros(docs)
        for bucket, bounds in grams(raw, at, len(self.table)):
            for k in range(len(self.langs)):
                run = np.zeros(len(bucket) + 1)
                np.cumsum(self.table[:, k][bucket], out=run[1:])
                logit[:, k] += np.diff(run[bounds])
            n += np.diff(bounds)
        logit = logit / np.maximum(n, 1)[:, None] + self.bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    def any_of(table: np.ndarray) -> np.ndarray:
        run = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(table[raw], out=run[1:])
        return np.diff(run[at]) > 0

    out = any_of(_ASCII_LETTER)
    for i in np.flatnonzero(~out & any_of(_HIGH)):
        out[i] = any(ch.isalpha() for ch in raw[at[i] : at[i + 1]].tobytes().decode())
    return out


def _counts(raw: np.ndarray, at: np.ndarray, buckets: int) -> np.ndarray:
    docs = len(at) - 1
    x = np.zeros((docs, buckets), dtype=np.float32)
    for bucket, bounds in grams(raw, at, buckets):
        doc = np.repeat(np.arange(docs), np.diff(bounds))
        x += np.bincount(doc * buckets + bucket, minlength=docs * buckets).reshape(docs, buckets).astype(np.float32)
    return x / np.maximum(x.sum(axis=1, keepdims=True), 1)


def fit(texts: list[str], langs: list[str], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    pieces, y, held = [], [], []
    for i, (t, lang) in enumerate(zip(texts, langs, strict=True)):
        words = t.split()
        pieces.append(t.encode())
        for _ in range(SPANS):
            size = int(rng.integers(4, 40))
            a = int(rng.integers(0, max(1, len(words) - size)))
            pieces.append(" ".join(words[a : a + size]).encode())
        y += [names.index(lang)] * (1 + SPANS)
        held += [i % 10 == 0] * (1 + SPANS)
    y, held = np.array(y), np.array(held)
    at = np.zeros(len(pieces) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in pieces], out=at[1:])
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    x = np.concatenate([_counts(raw[at[i] : at[min(i + 64, len(pieces))]], at[i : min(i + 64, len(pieces)) + 1] - at[i], buckets) for i in range(0, len(pieces), 64)])
    train = np.flatnonzero(~held) if (~held).any() else np.arange(len(y))
    e = rng.normal(0, 1.0, (buckets, dim)).astype(np.float32)
    w, b = np.zeros((dim, len(names)), dtype=np.float32), np.zeros(len(names), dtype=np.float32)
    rate = 4.0
    for epoch in range(epochs):
        order = rng.permutation(train)
        for i in range(0, len(order), 64):
            k = order[i : i + 64]
            hidden = x[k] @ e
            z = hidden @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(k)), y[k]] -= 1
            p /= len(k)
            step = rate * (1 - epoch / epochs)
            back = p @ w.T
            w -= step * hidden.T @ p
            b -= step * 0.1 * p.sum(axis=0)
            e -= step * 8 * (x[k].T @ back)
    table, check = (e @ w).astype(np.float64), np.flatnonzero(held) if held.any() else train
    z = x[check].astype(np.float64) @ table + b

    def probs(t: float) -> np.ndarray:
        p = np.exp(t * (z - z.max(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)

    scales = np.geomspace(0.25, 8, 26)
    scale = float(min(scales, key=lambda t: -np.log(np.maximum(probs(t)[np.arange(len(check)), y[check]], 1e-12)).mean()))
    p = probs(scale)
    top, right = p.max(axis=1), p.argmax(axis=1) == y[check]
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCEPT_ACCURACY)
    return Model(names, table * scale, b.astype(np.float64) * scale, float(top[order][good[-1]]) if len(good) else 1.0)


def fit_language(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``train_rows`` texts outside the held-out fold, those with the smallest id hashes."""
    rows = docs.filter((crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = smallest(rows.select("doc_id").distinct(), train_rows, F.col("doc_id"))
    got = rows.select("doc_id", "lang", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toPandas()
    return fit(got["text"].tolist(), got["lang"].tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, accepted (the score reaches the calibrated threshold)."""

    def run(it):
        for b in it:
            for lo, hi, raw, at in chunks(b.column("text")):
                ids = b.column("doc_id").slice(lo, hi - lo)
                known = has_letter(raw, at) & bool(model.langs)
                if model.langs:
                    p = model.scores(raw, at)
                    best, top = p.argmax(axis=1), np.where(known, p.max(axis=1), 0.0)
                else:
                    best, top = np.zeros(hi - lo, dtype=int), np.zeros(hi - lo)
                lang = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(crc_mod_np(ids, FOLDS) == HELD_OUT), pa.array(lang, pa.string()), pa.array(top), pa.array(known & (top >= model.accept))], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
