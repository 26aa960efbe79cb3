"""A training-data pipeline over ``documents``, each stage one operator of ``knightshift.llm``.

    toxicity     documents that the toxicity model rejects go
    exact dedup  of equal texts the row with the largest doc_id stays
    ngram join   of each group of near copies the row with the smallest doc_id stays
    mixing       every document as often as the mix of sources takes it
    packing      bucket, batch and slot of every piece (the last stage: one row per piece)

Edge cases, stage by stage: null and empty texts score 0 and are not toxic, equal each
other as copies (the row with the largest id stays), are near copies of nothing, have
no words that the mix could count and are one piece of length 0.  A null id is the
smallest id of a group of copies; rows of tied ids and texts leave one.  Rows with a
null language or source are a group of their own.  Empty tables pass every stage empty.
Columns besides those of ``documents`` pass all stages but the last, whatever their names.

All stages but the last return the columns of their input.  Each works on all
rows its predecessor kept; every result is written and read again before the
next stage.  ``ORACLE_SQL`` is None: the model, the index and the budget fit are
not SQL; the tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knightshift.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from knightshift.llm.common import ship_package, table
from knightshift.session import cut_lineage

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.clean(spark, docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mixed_rows(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("ngram join", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack_batches)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
