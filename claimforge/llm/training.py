"""Bounded, repeatable samples of labelled rows for the models that are fitted on the driver."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def crc_mod_np(doc_id: pa.Array, n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if v is None else str(v).encode()) % n for v in doc_id.to_pylist()), dtype=np.int64, count=len(doc_id))


def smallest(rows: DataFrame, n: int, key: Column) -> DataFrame:
    """At most n rows: those with the smallest hash of the key, the same in every run."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def sampled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of a bounded id table (at most the rows given to ``smallest``, hence safe to broadcast), one for each id:
    of several texts the smallest."""
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy(*ids.columns).agg(F.min("text").alias("text"))
