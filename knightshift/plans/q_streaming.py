"""Registered queries: the streaming jobs (ST1-ST4), each fed by landing the input
in arrival chunks and triggering ``availableNow`` after every chunk, then
compared with its batch twin's oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_half_away
from ..session import scratch_path
from ..streaming import jobs as ST
from . import fixtures as fx
from .q_puzzles import HEADER, MIN_RATING, POP_MIN, RAW_SQL, STORED_RATING, _dump_lines
from .registry import ORACLES, query

CHUNKS = 3


def land_in_chunks(df: DataFrame, order_col: str, chunks: int, write, after) -> None:
    """Split ``df`` into ``chunks`` arrival slices by quantiles of ``order_col`` (ties stay
    together), ``write(slice, i)`` each, and call ``after()`` once per slice."""
    qs = [i / chunks for i in range(1, chunks)]
    bounds = df.select(F.col(order_col).cast("double").alias("o")).approxQuantile("o", qs, 0.001)
    chunk = F.lit(0)
    for b in bounds:
        chunk = chunk + F.when(F.col(order_col).cast("double") > b, 1).otherwise(0)
    tagged = df.withColumn("__chunk", chunk)
    for i in range(chunks):
        write(tagged.where(F.col("__chunk") == i).drop("__chunk"), i)
        after()


def _events(spark, d):
    return fx.table(spark, d, "events").select(
        F.col("event_type").alias("engine"), "ts", "event_id", (F.col("value") >= 100).alias("is_correct"))


@query("stream_ingest", f"WITH {RAW_SQL} SELECT puzzle_id, rating FROM firsts")
def q_stream_ingest(spark, d):
    landing, sink, ck = (scratch_path(spark, x) for x in ("land_dump", "stream_puzzles", "ck_ingest"))
    lines = _dump_lines(spark, d).select("pos", "value")
    head = spark.createDataFrame([(HEADER,)], "value string")
    # puzzles already stored before the stream starts
    stored = (ST.P.accepted_dump(_raw_for_stored(spark, d), MIN_RATING, POP_MIN)
              .where(F.col("rating") >= STORED_RATING).select("puzzle_id"))

    def write(part, i):
        head.unionByName(part.select("value")).write.mode("overwrite").text(f"{landing}/chunk={i}")

    land_in_chunks(lines, "pos", CHUNKS, write,
                   lambda: ST.ingest_stream(spark, landing, sink, ck, MIN_RATING, POP_MIN, stored_ids=stored))
    # the same files again: nothing new
    ST.ingest_stream(spark, landing, sink, ck, MIN_RATING, POP_MIN, stored_ids=stored)
    return spark.read.parquet(sink).select("puzzle_id", "rating")


def _raw_for_stored(spark, d):
    from ..sources.puzzles import read_puzzle_dump
    from .q_puzzles import _dump_path
    return read_puzzle_dump(spark, _dump_path(spark, d))


@query("stream_score")
def q_stream_score(spark, d):
    landing, sink, ck = (scratch_path(spark, x) for x in ("land_answers", "stream_scored", "ck_score"))
    answers = fx.fx_answers(spark, d).drop("engine_id")
    schema = answers.drop("pos").schema
    puzzles = fx.fx_puzzles(spark, d)
    land_in_chunks(answers, "pos", CHUNKS,
                   lambda part, i: part.drop("pos").write.mode("overwrite").parquet(f"{landing}/chunk={i}"),
                   lambda: ST.score_stream(spark, landing, schema, puzzles, sink, ck))
    return spark.read.parquet(sink).drop("batch")


@query("stream_score_bucketed")
def q_stream_score_bucketed(spark, d):
    """The puzzles stored in buckets: a micro-batch moves its answers to them."""
    landing, sink, ck = (scratch_path(spark, x) for x in ("land_answers", "stream_scored", "ck_score"))
    answers = fx.fx_answers(spark, d).drop("engine_id")
    schema = answers.drop("pos").schema
    puzzles = ST.bucketed_puzzles(fx.fx_puzzles(spark, d), 16)
    land_in_chunks(answers, "pos", CHUNKS,
                   lambda part, i: part.drop("pos").write.mode("overwrite").parquet(f"{landing}/chunk={i}"),
                   lambda: ST.score_stream(spark, landing, schema, puzzles, sink, ck))
    return spark.read.parquet(sink).drop("batch")


ORACLES["stream_score"] = ORACLES["stream_score_bucketed"] = ORACLES["score_answers"]


@query("stream_rollup", """
SELECT event_type AS engine, COUNT(*) AS processed,
       CAST(SUM(CASE WHEN value >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       ROUND(SUM(CASE WHEN value >= 100 THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 2) AS accuracy_pct
FROM events GROUP BY event_type""")
def q_stream_rollup(spark, d):
    landing, sink, ck = (scratch_path(spark, x) for x in ("land_events", "stream_totals", "ck_rollup"))
    ev = _events(spark, d)
    schema = ev.schema
    land_in_chunks(ev, "event_id", CHUNKS,
                   lambda part, i: part.write.mode("overwrite").parquet(f"{landing}/chunk={i}"),
                   lambda: ST.rollup_stream(spark, landing, schema, sink, ck, every=2))
    t = ST.read_totals(spark, sink)
    return t.withColumn("accuracy_pct", round_half_away(F.col("solved") * 100.0 / F.col("processed"), 2))


@query("stream_running")
def q_stream_running(spark, d):
    landing, sink, ck = (scratch_path(spark, x) for x in ("land_events2", "stream_running", "ck_running"))
    ev = _events(spark, d)
    schema = ev.schema
    # arrival order = (ts, event_id): chunks are cut on ts so ties never straddle two batches
    ev_t = ev.withColumn("__o", F.unix_micros(F.col("ts").cast("timestamp")))
    land_in_chunks(ev_t, "__o", CHUNKS,
                   lambda part, i: part.drop("__o").write.mode("overwrite").parquet(f"{landing}/chunk={i}"),
                   lambda: ST.running_stream(spark, landing, schema, sink, ck))
    return spark.read.parquet(sink).drop("batch")


ORACLES["stream_running"] = ORACLES["running_accuracy"]
