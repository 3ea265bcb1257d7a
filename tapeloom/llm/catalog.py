"""Named queries of this folder: each applies one operator, with production parameters, to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.automaton import find_contamination
from tapeloom.llm.conversation_trie import conversation_trie
from tapeloom.llm.lsh_forest import near_duplicates
from tapeloom.llm.poisson_mix import mix_sources
from tapeloom.llm.prefix_free import remove_repeats
from tapeloom.llm.site_bayes import classify_quality
from tapeloom.llm.spelling import group_spellings
from tapeloom.llm.sql import ARCHIVE, CONTAMINATION, MIXTURE, SPELLINGS, TRIE, URLS
from tapeloom.llm.style_tree import extract_main_text
from tapeloom.llm.toxicity import score_toxicity
from tapeloom.llm.url_rules import filter_urls
from tapeloom.llm.vector_packing import assign_shards
from tapeloom.llm.warc import read_archives, write_archives
from tapeloom.llm.weak_supervision import judge_quality
from tapeloom.session import scratch_folder, utc
from tapeloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register fn(spark, sf_dir) -> DataFrame, with SQL for its rows where SQL can express them."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(utc(spark), sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak supervision over the text counts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs, with_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                                      "quality_probability", "kept")


@query("op9_decontamination", CONTAMINATION)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op6_near_duplicates")
def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a similarity of 0.85 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_repeated_passages")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of 100-byte strings that start earlier too."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


@query("op1_sharding")
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes (and tokens, and rows); equal texts stay together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return assign_shards(docs.withColumn("text_crc32", crc)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                                                    F.lit(None).cast("int").alias("grown_shard"))


@query("op3_source_mixture", MIXTURE)
def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, each as often as its Poisson draw says, in a global random order."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "replica", "shuffle_key", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


@query("op2_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: the host is its source, the path its source and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = classify_quality(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"), with_text=False)
    return judged.select("doc_id", "p_text", "p_site", "quality", "kept")


@query("op4_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op8_url_filter", URLS)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    site_rule = F.when(~F.col("rule").startswith("*"), F.col("rule"))
    return judged.select("page_id", "host", "path", site_rule.alias("rule"), "verdict")


@query("op10_warc", ARCHIVE)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    folder = f"{scratch_folder(spark)}/warc"
    archives = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(archives, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is, by a network trained on four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op12_conversation_trie", TRIE)
def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, with totals over their subtrees."""
    return conversation_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@query("op13_spelling_variants", SPELLINGS)
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, with typing errors drawn by hash, and the frequent word that each is a variant of."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return group_spellings(docs).select("word", "form", "root", "n", "n_near", "form_n")
