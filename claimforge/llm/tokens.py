"""Token counts by a separator scan over flat token blocks.

``write_tokens`` tokenises texts into flat streams: the ids of all texts of a task, each text followed by the
end-of-document id, cut into blocks of ``BLOCK`` ids wherever the cut falls. ``scan`` knows only those blocks: it
searches each for the separator with one vectorised comparison; a prefix scan over the blocks' summaries (ids before,
separators before, last separator before) then stitches documents that cross borders. Flat files written by others
are read by ``blocks_of_files``.

Scale: one scan of the texts; the blocks are Parquet rows in the shared folder, two bytes an id before compression.
Only summaries are shuffled: a row for each block with its separators' places, by stream, and a count and an id per document.

Nulls: null and empty texts have no ids, only their separator; repeated rows are counted one by one; a null doc_id is
carried as null; an empty table gives an empty result. Other columns are ignored. An id that equals the separator
cannot come from a text: ordinary encoding knows no special tokens.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from claimforge.llm.io import materialise

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
EOD = 50256
BLOCK = 1 << 18
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[int, object] = {}


def encoder(ranks: bytes):
    """The encoding of a vocabulary file's bytes, made once in a process."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def write_tokens(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, eod: int = EOD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(stream, block, data): little-endian 16-bit ids in flat blocks; and (stream, ordinal, doc_id): the order of the texts.

    The vocabulary's ids and ``eod`` must be below 65,536; a larger one raises.
    """
    with open(os.path.join(tokenizers, vocabulary), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(it):
        enc = encoder(shared.value)
        if max(enc.max_token_value, eod) > 0xFFFF:
            raise ValueError("ids of this vocabulary do not fit 16 bits")
        stream, number, held, size, first = TaskContext.get().partitionId(), 0, [], 0, 0
        names = ["stream", "at", "data", "ids"]

        def row(at: int, ids: np.ndarray | None, order: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([stream], pa.int64()), pa.array([at], pa.int64()), pa.array([None if ids is None else ids.astype("<u2").tobytes()], pa.binary()), pa.array([order], pa.list_(pa.int64()))], names)

        mark = np.array([eod], dtype=np.uint16)
        for b in it:
            order = b.column("doc_id").to_pylist()
            if order:
                yield row(first, None, order)
                first += len(order)
            for text in b.column("text"):
                text = text.as_py()
                ids = enc.encode_to_numpy(text, disallowed_special=()).astype(np.uint16) if text else mark[:0]
                held += [ids, mark]
                size += len(ids) + 1
                if size >= block:
                    flat = np.concatenate(held)
                    while len(flat) >= block:
                        yield row(number, flat[:block], None)
                        flat, number = flat[block:], number + 1
                    held, size = [flat], len(flat)
        if size:
            yield row(number, np.concatenate(held), None)

    made = materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "stream long, at long, data binary, ids array<long>"), "tokens")
    order = made.filter("ids IS NOT NULL").select("stream", "at", F.posexplode("ids").alias("_k", "doc_id"))
    return made.filter("data IS NOT NULL").select("stream", F.col("at").alias("block"), "data"), order.select("stream", (F.col("at") + F.col("_k")).alias("ordinal"), "doc_id")


def blocks_of_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(stream, block, data) of flat files of 16-bit ids, a stream for each file."""

    def run(it):
        for b in it:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_buffer()
                for n, at in enumerate(range(0, data.size, 2 * block)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([data.slice(at, min(2 * block, data.size - at)).to_pybytes()], pa.binary())], ["stream", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "stream string, block long, data binary")


def scan(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(stream, ordinal, n_tokens) per document.

    Ids after a stream's last separator are a document that never ended; they are not reported.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def run(it):
        for b in it:
            at, n = [], []
            for data in b.column("data"):
                ids = np.frombuffer(data.as_buffer(), dtype="<u2")
                at.append(np.flatnonzero(ids == eod).astype(np.int32))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([b.column("stream"), b.column("block"), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32()))], ["stream", "block", "n", "seps"])

    found = blocks.select("stream", "block", "data").mapInArrow(run, f"stream {kinds['stream']}, block long, n long, seps array<int>")
    before = W.partitionBy("stream").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    x = found.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    x = x.withColumn("_ordinal", F.coalesce(F.sum(F.size("seps")).over(before), F.lit(0)))
    x = x.withColumn("_open", F.coalesce(F.max(F.when(F.size("seps") > 0, F.col("_base") + F.element_at("seps", -1) + 1)).over(before), F.lit(0)))
    each = x.select("stream", "_base", "_ordinal", "_open", "seps", F.posexplode("seps").alias("_k", "_sep"))
    start = F.when(F.col("_k") == 0, F.col("_open")).otherwise(F.col("_base") + F.element_at("seps", F.greatest(F.col("_k"), F.lit(1))) + 1)
    return each.select("stream", (F.col("_ordinal") + F.col("_k")).alias("ordinal"), (F.col("_base") + F.col("_sep") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Per document: doc_id, n_tokens. The scan sees flat ids only; its counts meet the documents by their order."""
    blocks, order = write_tokens(docs, tokenizers)
    return scan(blocks).join(order, ["stream", "ordinal"]).select("doc_id", "n_tokens")
