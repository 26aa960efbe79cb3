"""The thin queries over the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import functools
import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, merkle, mixing, ngram_join, packing, pii, prefix_trie, quality_classifier, quality_rules, token_counts, toxicity, url_filter, warc
from .common import held_out, ship_package, table

MAX_TOKENS = 1024
QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run
    return deco


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file (a parameter of the operator; the files stay where they are)."""
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.join(spec.submodule_search_locations[0], name)


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, tokenizer_file())
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


@query("op2_quality_rules", quality_rules.SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the line-frequency verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op3_ngram_jaccard")
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document at a Jaccard similarity of 0.75."""
    return ngram_join.components(table(spark, sf_dir, "documents"))


@query("op4_packing", packing.pack_sql())
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op6_exact_dedup", """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (w ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document."""
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal-data spans of every document."""
    return pii.summary(table(spark, sf_dir, "documents"))


@query("op8_warc", warc.DIGEST_SQL)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with the offending sentences."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    span = F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.concat_ws(",", span).alias("offending"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op11_prefix_trie", prefix_trie.SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@query("op12_merkle", merkle.SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document; a third of the ids has its text's letters lower-cased."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.small_letters(F.col("text"))).otherwise(F.col("text"))
    return merkle.audit(docs, tampered)


@query("op13_url_filter")
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")
