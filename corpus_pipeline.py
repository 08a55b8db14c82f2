"""A training corpus from raw documents, in stages that are written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but
the last return the columns of ``documents``, whatever further columns there are, and all of
them take empty tables, texts of any length and rows that repeat.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillfin.llm import bpe, common, decontaminate, exact_dedup, near_dedup, pu_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the classifier, trained on these documents, does not reject.

    Every row is judged by itself, null texts as empty ones, so repeated rows share a fate.
    """
    model = pu_quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return pu_quality.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of equal texts (A-Z lower-cased; null as empty), that with the largest id.

    Of rows that repeat id and text exactly one stays; null ids are never preferred.
    """
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the least id.

    Null and empty texts are near nothing and stay; an id on several texts loses none that
    has no other copy; null ids come last.
    """
    return near_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents into which no benchmark item leaks; null and empty texts stay, and so
    does a clean row whose id another, contaminated row has.
    """
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode whole texts and decode them again: doc_id, n_tokens and digests of both.

    A row for each row; null texts count as empty and have no tokens.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL expresses neither the classifier nor the links and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    path = common.workspace(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with common.scratch(spark):
            docs = common.stage(stage(spark, docs, sf_dir), f"{path}/{k}-{name}")
    return docs
