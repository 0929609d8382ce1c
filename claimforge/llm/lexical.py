"""Ranked lexical search: term-bucketed postings, joined with the items' terms, scored in integers and ranked by windows.

One scan of the texts writes the postings (bucket, term, row, doc_id, tf, n) of the words that items hold, sorted by
bucket and term inside its files, so that a search reads the row groups of its own buckets. A map of ``MAP_BITS`` bits
over hashed item terms (1 MB, whatever the input) keeps other words from leaving a task; where it lets one pass by
chance, the join drops it. Document frequencies, the number of documents and the sum of their lengths are aggregates of
that table. The postings are then dealt by document, each term of a block of items is joined with them, a match gives
weight * saturated frequency in 64-bit integers, and the sums by item and document need no further shuffle. A window
gives the ranks; Spark limits each task to the best k of an item before rows meet.

Scale: the texts are read once and never shuffled; a posting of the items' words is shuffled once, by document, so a
word or source of any share spreads evenly. Terms of items are broadcast in blocks of about ``BLOCK_TERMS`` rows,
counted first; further blocks read the postings again. Work is the number of matches: every posting of an item's word.

Nulls, ties and repeats: a null or wordless text has no terms and no part in any count; a null or wordless item gives no
rows. Rows that repeat a doc_id are documents of their own; rows that repeat an item_id (or have none) are one item with
the words of all. Equal scores rank by doc_id, null ids last. Texts of any length are read whole, one at a time. Empty
tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from claimforge.llm.io import bound_batches, materialise, partitions

TOP, B_PARTS, B_LENGTH = 10, 100, 90
BUCKETS, BLOCK_TERMS = 256, 100_000
MAP_BITS, ROW_BITS = 1 << 23, 32768
#: Bytes of a word: digits, letters and all of any character beyond ASCII. Other bytes separate; A-Z become a-z.
_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | set(range(128, 256))
TABLE = bytes(b | 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))
KNOWN = 1 << 18
POSTINGS = "term string, row long, doc_id {id}, tf long, n long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""

    def run(it):
        for b in it:
            ids, terms = [], []
            for i, text in zip(b.column("item_id"), b.column("text").cast(pa.binary())):
                own = set(terms_of(text.as_py() or b""))
                ids += [i.as_py()] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column("item_id").type), pa.array(terms, pa.binary()).cast(pa.string())], ["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string").distinct()


def term_map(terms: DataFrame) -> np.ndarray:
    """The map of hashed terms as MAP_BITS / 8 bytes; its rows, and so what reaches the driver, are bounded by MAP_BITS."""
    at = F.pmod(F.crc32(F.encode("term", "utf-8")), F.lit(MAP_BITS))
    rows = terms.select(at.alias("at")).groupBy(F.floor(F.col("at") / ROW_BITS).cast("int").alias("r")).agg(F.bitmap_construct_agg(F.pmod(F.col("at"), F.lit(ROW_BITS))).alias("m"))
    out = np.zeros((MAP_BITS // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in rows.collect():
        out[r.r] = np.frombuffer(r.m, np.uint8)
    return out.ravel()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Written postings of the terms; in each batch a row without a term has the number of its documents and of their words."""
    spark = docs.sparkSession
    bits = term_map(terms)

    def run(it):
        known: dict[bytes, bool] = {}
        for b in it:
            out_terms, rows, ids, tfs, lengths, n_docs, n_words = [], [], [], [], [], 0, 0
            for row, doc_id, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
                words = terms_of(text.as_py() or b"")
                if not words:
                    continue
                n_docs, n_words = n_docs + 1, n_words + len(words)
                for w, tf in Counter(words).items():
                    wanted = known.get(w)
                    if wanted is None:
                        at = zlib.crc32(w) % MAP_BITS
                        wanted = bool(bits[at >> 3] >> (at & 7) & 1)
                        if len(known) < KNOWN:
                            known[w] = wanted
                    if wanted:
                        out_terms.append(w)
                        rows.append(row)
                        ids.append(doc_id)
                        tfs.append(tf)
                        lengths.append(len(words))
            cols = [pa.array([*out_terms, None], pa.binary()).cast(pa.string()), pa.array([*rows, -1], pa.int64()), pa.array([*ids, None], b.column("doc_id").type), pa.array([*tfs, n_docs], pa.int64()), pa.array([*lengths, n_words], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["term", "row", "doc_id", "tf", "n"])

    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, POSTINGS.format(id=kind))
    return materialise(found.withColumn("bucket", bucket()).sortWithinPartitions("bucket", "term"), "postings")


def bucket():
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


def weighted_terms(terms: DataFrame, index: DataFrame, stats: DataFrame) -> DataFrame:
    """(item_id, term, w): a term of no document, or whose weight is 0, adds nothing and is left out."""
    df = index.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = (2 * F.col("n_docs") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    x = terms.join(df, "term").crossJoin(F.broadcast(stats))  # one row
    return x.select("item_id", "term", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("w")).filter("w > 0")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    terms = materialise(item_terms(items), "item-terms")
    index = postings(docs, terms)
    stats = index.filter("term IS NULL").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_words"))
    wanted = materialise(weighted_terms(terms, index, stats).withColumn("bucket", bucket()), "item-weights")
    n_blocks = max(1, math.ceil(wanted.count() / block_terms))
    length = F.expr(f"({B_LENGTH} * n * n_docs) div n_words") + (B_PARTS - B_LENGTH)
    ratio = F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)")
    dealt = index.filter("term IS NOT NULL").repartition(partitions(docs), "row").crossJoin(F.broadcast(stats)).select("bucket", "term", "row", "doc_id", "tf", length.alias("m")).select("bucket", "term", "row", "doc_id", ratio.alias("ratio"))
    out = None
    for i in range(n_blocks):
        block = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i)
        matches = dealt.join(F.broadcast(block), ["bucket", "term"])  # about block_terms rows
        sums = matches.groupBy("item_id", "row").agg(F.sum(F.col("w") * F.col("ratio")).alias("score"), F.first("doc_id").alias("doc_id"))
        order = W.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = sums.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
