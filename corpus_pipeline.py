"""From raw documents to balanced shards: quality rules, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and reread as the next one's docs.
All stages but the last return the columns they got.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.automaton import remove_contamination
from tapeloom.llm.frames import set_aside, staged
from tapeloom.llm.lsh_forest import keep_one_of_each
from tapeloom.llm.poisson_mix import mix_sources
from tapeloom.llm.vector_packing import assign_shards
from tapeloom.llm.weak_supervision import judge_quality
from tapeloom.session import utc
from tapeloom.sources.tables import table

# The quality stage's posterior and the near-dedup stage's components have no SQL form; tests compare with brute force.
ORACLE_SQL = None
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go."""
    aside, columns = set_aside(docs, ["text"])
    return judge_quality(aside).filter("kept").select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, a similarity of 0.8 or more) stays."""
    return keep_one_of_each(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go."""
    cut = remove_contamination(docs, table(spark, sf_dir, "benchmark"))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask, in a global random order."""
    aside, columns = set_aside(docs, ["doc_id", "source", "text"])
    return mix_sources(aside).select(*columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return assign_shards(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mixture", source_mixture), ("sharding", sharding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(utc(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
