"""Structured Streaming forms of the incremental jobs (ST1-ST4).

Every job reads a landing folder with the file source, keeps its progress in
a checkpoint folder (shared storage), and writes through ``foreachBatch``
with the batch id in the output path, so a replayed batch overwrites its own
output instead of appending twice.  ``trigger(availableNow=True)`` processes
what has landed and stops; the next run resumes from the checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import round_half_away
from ..operators import puzzles as P
from ..operators.ordered import running_totals
from ..operators.scoring import score_answers
from ..plans.joins import bounded_broadcast
from ..session import cut_lineage, scratch_path
from ..sources.puzzles import CSV_COLUMNS, OPTIONAL, REQUIRED, empty_if_missing

ID_BUCKETS = 64             # folders of the id index in a batch
SNAPSHOT_EVERY = 50         # versions between two full sets of totals


def _idempotent_writer(sink: str, fn=None):
    """foreachBatch handler: (optionally transform, then) write the batch under ``batch=<id>``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        out = fn(batch, batch_id) if fn is not None else batch
        out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
    return handle


def _run(stream_writer) -> None:
    q = stream_writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def id_bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def stored_hits(spark: SparkSession, ids: str, batch_ids: DataFrame, batch_id: int, buckets: int) -> DataFrame:
    """ST1: the ids of a batch that earlier batches stored, from the id index at ``ids`` (``batch=`` / ``bucket=`` folders).

    Only the buckets that the batch's ids fall into are read (at most ``buckets`` numbers reach the driver); in their
    files the id ranges and Bloom filters of the row groups decide further.  Rows of this batch itself, from a run that
    was cut off, do not count.
    """
    kind = "puzzle_id string, batch long, bucket int"
    own = batch_ids.select("puzzle_id", id_bucket("puzzle_id", buckets).alias("bucket"))
    wanted = [r["bucket"] for r in own.select("bucket").distinct().collect()]
    index = empty_if_missing(lambda: spark.read.schema(kind).parquet(ids), spark, kind)
    held = index.where(F.col("bucket").isin(wanted) & (F.col("batch") != batch_id))
    # the batch's ids (bounded by the trigger) are broadcast into the scan: the store is never shuffled
    return held.join(bounded_broadcast(own), ["puzzle_id", "bucket"], "left_semi").select("puzzle_id").distinct()


def ingest_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, min_rating: int,
                  popularity_min: int, headers=CSV_COLUMNS, stored_ids: DataFrame | None = None, buckets: int = ID_BUCKETS) -> None:
    """ST1: dump lines landing as text files -> new, first-seen, accepted puzzles.

    Per micro-batch: classify (stateless), keep the first row of each id in
    file order, drop ids already stored or in ``stored_ids`` (anti joins), write the
    puzzles, then their ids into the bucketed index beside the sink.  A batch that was
    cut off between the two is run again under its number and overwrites both.  A second run
    over the same files adds nothing: the file source remembers processed files in its checkpoint.
    """
    lines = (spark.readStream.format("text").load(landing)
             .select("value", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block")))
    header_line = ",".join(headers)
    ids = sink.rstrip("/") + "-ids"

    def handle(batch: DataFrame, batch_id: int) -> None:
        # inside a micro-batch the frame is static: number lines in scan order
        own = batch.sparkSession
        numbered = batch.withColumn("seq", F.monotonically_increasing_id())
        parts = F.transform(F.split("value", ",", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        rows = numbered.where(F.col("value") != header_line).select("file", "block", "seq", parts.alias("parts"))
        cols = {h: F.try_element_at("parts", F.lit(headers.index(h) + 1)) for h in REQUIRED + OPTIONAL if h in headers}
        raw = rows.select("file", "block", "seq", F.size("parts").alias("n_fields"),
                          F.lit(len(headers)).alias("n_header"), *[v.alias(k) for k, v in cols.items()])
        ok = P.accepted_dump(raw, min_rating, popularity_min)
        first = cut_lineage(P.dedupe_first(ok), "batch")      # the batch is worked out once
        fresh = P.new_puzzles(first, stored_hits(own, ids, first, batch_id, buckets))
        if stored_ids is not None:
            known = stored_ids.join(bounded_broadcast(first.select("puzzle_id")), "puzzle_id", "left_semi")
            fresh = P.new_puzzles(fresh, known)
        out = fresh.select("puzzle_id", "fen", "solution", "rating", "popularity", "themes")
        out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        write_id_index(own.read.parquet(f"{sink}/batch={batch_id}"), f"{ids}/batch={batch_id}", buckets)

    _run(lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle))


def write_id_index(rows: DataFrame, path: str, buckets: int) -> None:
    """ST1: the ids of ``rows`` in one file a bucket, sorted, with a Bloom filter."""
    own = rows.select("puzzle_id", id_bucket("puzzle_id", buckets).alias("bucket"))
    (own.repartition("bucket").sortWithinPartitions("bucket", "puzzle_id").write.mode("overwrite")
     .option("parquet.bloom.filter.enabled#puzzle_id", "true").partitionBy("bucket").parquet(path))


def bucketed_puzzles(puzzles: DataFrame, buckets: int) -> DataFrame:
    """ST2: the puzzle table stored once in ``buckets`` files by ``puzzle_id``, below the shared scratch folder."""
    spark = puzzles.sparkSession
    name = f"ks_puzzles_{uuid.uuid4().hex[:12]}"
    (puzzles.select("puzzle_id", "fen", "solution", "rating").repartition(buckets, "puzzle_id").write.format("parquet")
     .option("path", scratch_path(spark, "puzzles")).bucketBy(buckets, "puzzle_id").sortBy("puzzle_id").saveAsTable(name))
    return spark.table(name)


def score_stream(spark: SparkSession, landing: str, schema: T.StructType, puzzles: DataFrame, sink: str,
                 checkpoint: str, max_files: int | None = None) -> None:
    """ST2: answers landing as Parquet, scored against the (static) puzzle table.

    The static side is broadcast when its bytes are within the bound (each micro-batch then joins map-side).  Give a larger
    one as ``bucketed_puzzles``: a micro-batch then moves its own rows to the buckets, and the puzzles are not shuffled."""
    puzzles = bounded_broadcast(puzzles.select("puzzle_id", "fen", "solution", "rating"))
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    answers = r.parquet(landing)
    scored = score_answers(puzzles, answers)
    _run(scored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(_idempotent_writer(sink)))


TOTALS = "engine string, processed long, solved long"


def publish_totals(changed: DataFrame, batch_id: int, sink: str, every: int = SNAPSHOT_EVERY) -> None:
    """ST3: store the totals that a batch changed as a version, then point to it.

    A version holds the changed engines only; every ``every`` versions all engines are written once more, so a reader opens few
    of them.  The pointer is a row added after the version is complete: until then readers stay with the one before,
    and a batch that is run again overwrites its own version and points to it again.
    """
    spark = changed.sparkSession
    before = _pointed(spark, sink, batch_id)
    base = before["base"] if before else None
    changed.select("engine", "processed", "solved").write.mode("overwrite").parquet(f"{sink}/versions/version={batch_id}")
    if base is None or batch_id - base >= every:
        base = batch_id
        _totals(spark, sink, before["base"] if before else batch_id, batch_id).write.mode("overwrite").parquet(f"{sink}/snapshots/version={batch_id}")
    spark.createDataFrame([(batch_id, base)], "version long, base long").write.mode("append").parquet(f"{sink}/pointer")


def _pointed(spark: SparkSession, sink: str, below: int | None = None):
    """The last version pointed to (before version ``below``), or None."""
    kind = "version long, base long"
    rows = empty_if_missing(lambda: spark.read.schema(kind).parquet(f"{sink}/pointer"), spark, kind)
    if below is not None:
        rows = rows.where(F.col("version") < below)
    return rows.orderBy(F.desc("version")).first()


def _totals(spark: SparkSession, sink: str, base: int, version: int) -> DataFrame:
    """Totals at ``version``: of each engine the last row among the snapshot ``base`` and the versions behind it."""
    kind = f"{TOTALS}, version long"
    part = lambda folder: empty_if_missing(lambda: spark.read.schema(kind).parquet(f"{sink}/{folder}"), spark, kind)
    rows = part("snapshots").where(F.col("version") == base).unionByName(
        part("versions").where((F.col("version") >= base) & (F.col("version") <= version)))
    last = F.max(F.struct("version", "processed", "solved")).alias("last")
    return rows.groupBy("engine").agg(last).select("engine", "last.processed", "last.solved")


def read_totals(spark: SparkSession, sink: str) -> DataFrame:
    """ST3: the totals last published."""
    at = _pointed(spark, sink)
    return _totals(spark, sink, at["base"], at["version"]) if at else spark.createDataFrame([], TOTALS)


def rollup_stream(spark: SparkSession, landing: str, schema: T.StructType, sink: str, checkpoint: str, every: int = SNAPSHOT_EVERY) -> None:
    """ST3: live per-engine totals (stateful aggregation; a batch publishes the engines it changed)."""
    answers = spark.readStream.schema(schema).parquet(landing)
    agg = answers.groupBy("engine").agg(
        F.count(F.lit(1)).alias("processed"),
        F.sum(F.col("is_correct").cast("bigint")).alias("solved"))
    _run(agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda batch, batch_id: publish_totals(batch, batch_id, sink, every)))


def running_stream(spark: SparkSession, landing: str, schema: T.StructType, sink: str, checkpoint: str,
                   max_files: int | None = None) -> None:
    """ST4: per-position running accuracy across batches.

    Row windows are not allowed on streams, so each micro-batch is numbered as a static frame by the balanced
    ``running_totals`` (an engine that holds most of a batch spreads over many tasks) and continues from the
    engines' totals after the batch before, one row per engine, kept beside the sink.  Both outputs of a batch
    are keyed by its id: a replay reads the same earlier totals and overwrites its own files.
    """
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    answers = r.parquet(landing).select("engine", "ts", "event_id", "is_correct")
    kept = sink.rstrip("/") + "-totals"
    kind = "engine string, n long, solved long, batch long"

    def per_batch(batch: DataFrame, batch_id: int) -> DataFrame:
        own = batch.sparkSession
        stored = empty_if_missing(lambda: own.read.schema(kind).parquet(kept), own, kind)
        last = stored.where(F.col("batch") == batch_id - 1).select(F.col("engine").alias("__e"), "n", "solved")
        right = F.col("is_correct").cast("long")
        numbered = running_totals(batch, ["engine"], ["ts", "event_id"], {"so_far": right}, row_number="rn")
        j = numbered.join(bounded_broadcast(last), F.col("engine").eqNullSafe(F.col("__e")), "left")
        out = cut_lineage(j.select(
            "engine", "event_id", (F.col("rn") + F.coalesce("n", F.lit(0))).cast("long").alias("processed"),
            (F.coalesce("so_far", F.lit(0)) + F.coalesce("solved", F.lit(0))).cast("long").alias("solved_so_far")), "running")
        now = out.groupBy("engine").agg(F.max("processed").alias("n"), F.max("solved_so_far").alias("solved"))
        rest = last.withColumnRenamed("__e", "engine")
        idle = rest.join(now.select(F.col("engine").alias("__now")), F.col("engine").eqNullSafe(F.col("__now")), "left_anti")
        now.unionByName(idle).write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")
        return out.withColumn("running_accuracy_pct", round_half_away(F.col("solved_so_far") * 100.0 / F.col("processed"), 2))

    _run(answers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(_idempotent_writer(sink, per_batch)))
