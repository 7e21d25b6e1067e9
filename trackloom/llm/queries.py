"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, line_dedup, ngram_join, packing, quality, repair, search, secret_scan, simhash, substring_dedup, token_counts, toxicity
from .common import table, text_of


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules of op1 alone, which SQL can express too."""
    base = quality.base_stats(text_of()).alias("s")
    failed = (F.col("n_words") < quality.MIN_WORDS) | (100 * F.col("n_repeat_words") > quality.MAX_REPEATED * F.col("n_words"))
    return table(spark, sf_dir, "documents").select("doc_id", base).select("doc_id", "s.*").withColumn("base_failed", failed)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited(table(spark, sf_dir, "documents"), token_counts.sample_edits())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.repeats_removed(table(spark, sf_dir, "documents")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digest(chat_format.expand(rows))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.cleaned(table(spark, sf_dir, "documents")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", packing.dealt_by().alias("deal"))
    known = ngram_join.measured(documents, "cluster", ("source", "deal"))
    return packing.pack(known, cluster=F.col("cluster"), units=F.col("words"), deal=F.col("deal"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.digest(rows, repair.damaged(rows))


_ALL = (
    op1_quality_rules,
    quality_base,
    op2_decontamination,
    op3_token_counts,
    op4_substring_dedup,
    op5_secret_scan,
    op6_chat_format,
    op7_ngram_join,
    op8_toxicity,
    op9_line_dedup,
    op10_packing,
    op11_simhash,
    op12_ranked_search,
    op13_structure_repair,
)
QUERIES = {f.__name__: f for f in _ALL}
