"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

toxicity: documents that score as toxic go. ngram_jaccard_join: of each group of near copies the document with the
smallest id stays. substring_dedup: passages of 50 words or more that a document of a smaller id holds are cut out.
benchmark_decontamination: words inside benchmark windows are cut out. mixing: words to take of each document so that
sources come near their target weights. A document without any text left by a cut goes; clean documents pass every
filter unchanged. Rows with a null or repeated doc_id, null texts and an empty table pass as the operators define.
"""

from __future__ import annotations

from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimforge.llm import fm_index, jaccard_join, mixing, passages, toxicity
from claimforge.llm.io import bound_batches, discard, materialise, release, table

#: No single SQL statement expresses stages 1, 3 and 4; the stages' operators are tested against brute force or held-out labels.
ORACLE_SQL = None


def plain(stage):
    """Runs a stage with columns beyond those of ``documents`` under names that no operator uses, and gives theirs back."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = ("doc_id", "text", "lang", "source", "n_chars")
        bound_batches(spark)
        names = docs.columns
        hidden = [n if n in own else f"__extra_{i}" for i, n in enumerate(names)]
        out = stage(spark, docs.toDF(*hidden), sf_dir)
        return out.toDF(*names) if out.columns == hidden else out

    return run_stage


@plain
def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the examples come from the labelled documents of the whole table."""
    index = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    kept = toxicity.score(docs, index, keep=tuple(c for c in docs.columns if c != "doc_id"))
    return kept.filter("predicted = 0").select(*docs.columns)


@plain
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component; repeated rows of that id are one document, and rows with another text are others."""
    found = jaccard_join.near_duplicates(docs, keep_hash=True).filter("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, (docs.doc_id == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti").select(*docs.columns)


@plain
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents of smaller ids hold."""
    return passages.cut(docs, materialise(passages.repeated_passages(docs), "pipeline-passages"))


@plain
def benchmark_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words inside benchmark windows."""
    found = fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    names = docs.columns

    def run(it):
        for b in it:
            rows = np.flatnonzero(np.diff(b.column("hits").offsets.to_numpy()) > 0)
            if not len(rows):
                yield b.select(names)
                continue
            text, gone = b.column("text").to_pylist(), set()
            for i in rows:
                text[i] = fm_index.without_hits(text[i], b.column("hits")[int(i)].as_py())
                if not text[i]:
                    gone.add(int(i))
            cols = {n: b.column(n) for n in names}
            cols["text"] = pa.array(text, pa.string())
            if "n_chars" in cols:
                hit = set(rows.tolist())
                cols["n_chars"] = pa.array([len(text[i]) if i in hit else v for i, v in enumerate(cols["n_chars"].to_pylist())], cols["n_chars"].type)
            out = pa.RecordBatch.from_arrays([cols[n] for n in names], names)
            yield out.take(pa.array([i for i in range(len(text)) if i not in gone], pa.int64())) if gone else out

    return found.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))


@plain
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: source, sizes, target and the words that the mix takes."""
    return mixing.mix_sources(docs.select("doc_id", "text", "source"), carry=("source",))


STAGES = [
    ("toxicity", toxic_documents),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_words),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
        discard(before)
        release(spark)
    return docs
