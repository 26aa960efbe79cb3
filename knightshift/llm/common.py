"""Helpers shared by the operators: tables, whole words, labelled samples."""

from __future__ import annotations

import multiprocessing
import os
import pickle
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knightshift.plans.joins import BROADCAST_BYTES, fits

#: Space and the control characters from tab to carriage return part words.
BLANKS = " \t\n\x0b\x0c\r"
FOLDS = 5
BATCH_ROWS = 2_000
HOT_SHARE = 100             # a group with more than one row in so many is hot
LONG_SHARE = 16             # a text of more than this part of a sample's bytes comes last


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Whole texts go to Python in Arrow batches; a session that allows more rows in one is set to ``BATCH_ROWS``, so that
    a worker holds some megabytes of text at a time.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="knightshift-"), "knightshift-package.zip")   # Spark serves it to the executors
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` (null and blank texts: empty)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def join_groups(rows: DataFrame, groups: DataFrame, same: Column, key: str, size: str, total: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of ``rows`` with one row a group, whatever share of the rows a group holds.

    ``groups`` has a non-null column ``key`` and ``size``, the number of the ``total`` rows that a group has.  Groups that
    measure small are broadcast whole.  Beyond that the hot ones, fewer than ``HOT_SHARE``, still are; the others,
    each with a hundredth of the rows at most, are joined by shuffle.
    """
    if fits(groups, max_bytes):
        return rows.join(F.broadcast(groups), same)
    marked = rows.join(F.broadcast(groups.where(F.col(size) * HOT_SHARE > total)), same, "left")
    rest = marked.where(F.col(key).isNull()).drop(*groups.columns).join(groups.hint("merge"), same)
    return marked.where(F.col(key).isNotNull()).unionByName(rest)


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, max_docs: int, max_bytes: int) -> DataFrame:
    """A seeded sample (doc_id, y, text, turn) of labelled texts outside the held-out fold, for fitting a model.

    At most ``max_docs`` documents (by a hash of the id) whose texts hold at most
    ``max_bytes`` together, however large the tables are.  They are chosen by id and
    size; only the texts chosen travel.  Texts of more than ``max_bytes / LONG_SHARE``
    come after all others, the shortest first, so that a long text cannot end the
    sample at its place in the order of the hashes.  A document labelled twice takes
    the larger label; of repeated rows of one id the shortest text counts, of equally
    long ones the smallest; null ids, labels and texts are left out.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    ids = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
           .orderBy(order, "doc_id").limit(max_docs))
    texts = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("octets")).where(F.col("text").isNotNull())
    sizes = texts.select("doc_id", "octets").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("octets").alias("octets"))
    turn = Window.orderBy(F.greatest("octets", F.lit(max_bytes // LONG_SHARE)), order, "doc_id")
    chosen = (sizes.withColumn("so_far", F.sum("octets").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
              .where(F.col("so_far") <= max_bytes).drop("so_far"))
    return (texts.join(F.broadcast(chosen), ["doc_id", "octets"]).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
            .withColumn("turn", order))


def fit_in_a_task(sample: DataFrame, train: Callable[[list[tuple[str, int]]], object]) -> object:
    """``train`` on the rows (text, y) of a bounded sample, in the order of their turns, in one task: the driver gets the model only.

    The training runs in a child of the task's process, whose memory goes with it (workers are used again).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        fork = multiprocessing.get_context("fork")
        here, there = fork.Pipe(duplex=False)
        child = fork.Process(target=lambda: there.send_bytes(pickle.dumps(train(rows))))
        child.start()
        there.close()
        try:
            model = here.recv_bytes()          # EOFError, and a failed task, if the child died
        finally:
            child.join()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    fitted = (sample.repartition(1).sortWithinPartitions("turn", "doc_id").select("text", "y").mapInArrow(run, "model binary").collect())
    return pickle.loads(fitted[0]["model"]) if fitted else train([])


#: DuckDB SQL: the table of the 256 remainders that ``crc32_sql`` looks up; put it among the CTEs of a query.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text."""
    return (f"(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), "
            f"lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) FROM crc_table)")
