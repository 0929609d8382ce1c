"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimforge.llm import chat, fm_index, sql
from claimforge.llm.centroids import cluster
from claimforge.llm.html import main_text
from claimforge.llm.io import table
from claimforge.llm.jaccard_join import near_duplicates
from claimforge.llm.language import fit_language, identify
from claimforge.llm.lexical import search
from claimforge.llm.mixing import mix_sources
from claimforge.llm.passages import repeated_passages
from claimforge.llm.pii import digests as pii_digests, personal_data
from claimforge.llm.quality import fit_quality, judge
from claimforge.llm.tokens import token_counts
from claimforge.llm.toxicity import fit_toxicity, score


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_language(docs))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold the template's own markers."""
    awkward = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(awkward)
    return chat.digests(chat.format_turns(turns))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fm_index.digests(fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(personal_data(table(spark, sf_dir, "documents")))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


_ALL = (
    op1_html_extraction, op2_toxicity, op3_token_counts, op4_jaccard_join, op5_substring_dedup, op6_language_id, op7_chat_format, op8_decontaminate,
    op9_quality_rules, op10_mix_sources, op11_pii, op12_ranked_search, op13_centroid_clustering,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op10_mix_sources": sql.MIX, "op12_ranked_search": sql.SEARCH, "op13_centroid_clustering": sql.CLUSTER}
