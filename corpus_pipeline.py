"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.

Near-duplicate and contamination stages work on five-word shingles and a similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from trackloom.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. Null and empty texts get the score of a text without matches; repeated rows go or stay alike."""
    return toxicity.harmless(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go, and ``n_chars`` follows; no document goes, and null texts stay null.

    Equal texts count as one document. Groups of near copies would too, but they come from Arrow code, which this stage may not
    run: what eight near copies have in common goes from all of them.
    """
    done = line_dedup.cleaned(docs)
    return done.withColumn("n_chars", F.when(F.size("_ld_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the smallest id, null last. Rows without words stay."""
    return ngram_join.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go; rows without an id stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the packed sequences; one without words has a row without a bin. Near duplicates are gone, so clusters are equal texts."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the first stage; tests hold ``run`` against a plain version of all stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
