"""Registered queries: result tables, CSV export, manifests, checkpoints, run
registration and engine transcripts (S5-S7, S12, K2, K4, K8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups as R
from .joins import bounded_broadcast
from ..session import landed, scratch_path
from ..sinks import files as K
from ..sources import puzzles as SP
from ..sources import runs as RUNS
from ..sources.transcript import parse_transcript, read_transcripts
from . import fixtures as fx
from .registry import query

SHARD = 20


def _results_path(spark, d):
    return landed(spark, f"results:{d}", lambda path: K.write_results(fx.fx_evals(spark, d).drop("pos"), path))


@query("write_results", """
SELECT run_id, engine_id, puzzle_id, engine_move, is_correct, depth, nps, elapsed_seconds FROM fx_evals""")
def q_write_results(spark, d):
    back = spark.read.parquet(_results_path(spark, d))
    return back.select("run_id", "engine_id", "puzzle_id", "engine_move", "is_correct", "depth", "nps", "elapsed_seconds")


@query("results_partition", """
SELECT puzzle_id, engine_move, is_correct FROM fx_evals WHERE run_id = 'run_b' AND engine_id = 'lc0_v0_32_1'""")
def q_results_partition(spark, d):
    back = spark.read.parquet(_results_path(spark, d))     # run_id / engine_id are partition columns: pruned
    return back.where((F.col("run_id") == "run_b") & (F.col("engine_id") == "lc0_v0_32_1")).select(
        "puzzle_id", "engine_move", "is_correct")


@query("src_results", """
SELECT run_id, engine, COUNT(*) AS n FROM fx_evals GROUP BY run_id, engine""")
def q_src_results(spark, d):
    path = _results_path(spark, d)
    schema = spark.read.parquet(path).schema
    empty = SP.read_results(spark, f"{path}/run_id=run_none/*", schema=schema)   # guard: no files
    got = SP.read_results(spark, path, schema=None)
    return got.unionByName(empty, allowMissingColumns=True).groupBy("run_id", "engine").agg(
        F.count(F.lit(1)).alias("n"))


@query("export_csv", """
SELECT engine, COUNT(*) AS total_puzzles, CAST(SUM(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       ROUND(AVG(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy_pct,
       ROUND(AVG(nps), 0) AS avg_nps, ROUND(AVG(depth), 1) AS avg_depth,
       ROUND(AVG(elapsed_seconds), 3) AS avg_sec_per_pos
FROM fx_evals GROUP BY engine""")
def q_export_csv(spark, d):
    fx.fx_evals(spark, d).createOrReplaceTempView("evals")
    sql = """SELECT engine, COUNT(*) AS total_puzzles, SUM(CASE WHEN is_correct THEN 1 ELSE 0 END) AS solved,
                    ROUND(AVG(CASE WHEN is_correct THEN 1.0D ELSE 0.0D END) * 100, 2) AS accuracy_pct,
                    ROUND(AVG(nps), 0) AS avg_nps, ROUND(AVG(depth), 1) AS avg_depth,
                    ROUND(AVG(elapsed_seconds), 3) AS avg_sec_per_pos
             FROM evals GROUP BY engine ORDER BY accuracy_pct DESC"""
    path = K.export_csv(spark, sql, scratch_path(spark, "export_csv"), single_file=True)
    schema = "engine string, total_puzzles bigint, solved bigint, accuracy_pct double, avg_nps double, " \
             "avg_depth double, avg_sec_per_pos double"
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def _manifest_rows(spark, d):
    ev = fx.fx_evals(spark, d)
    per_run = ev.groupBy("run_id").agg(
        F.countDistinct("puzzle_id").cast("int").alias("total_puzzles"),
        F.sort_array(F.collect_set("engine")).alias("engines"),      # bounded: the engine dimension
        F.min("rating").alias("min_rating"))
    return per_run.join(bounded_broadcast(fx.fx_runs(spark).select("run_id", "movetime_ms")), "run_id")


def _manifest_path(spark, d):
    m = _manifest_rows(spark, d).select(
        "run_id", "movetime_ms", "total_puzzles", "engines", "min_rating",
        F.lit("2026-01-01T00:00:00Z").alias("created_at"))
    path = scratch_path(spark, "manifests")
    # one document per run; run_b's document omits movetime_ms (default applies)
    m.where(F.col("run_id") == "run_a").coalesce(1).write.mode("overwrite").json(f"{path}/run_a")
    m.where(F.col("run_id") == "run_b").drop("movetime_ms").coalesce(1).write.mode("overwrite").json(f"{path}/run_b")
    return path


@query("src_manifests", """
SELECT run_id, 500 AS movetime_ms,
       CAST(COUNT(DISTINCT puzzle_id) AS INTEGER) AS total_puzzles, 1 AS concurrency,
       array_to_string(list_sort(list_distinct(list(engine))), ',') AS engines,
       CAST(MIN(rating) AS INTEGER) AS min_rating, false AS use_wandb
FROM fx_evals GROUP BY run_id""")
def q_src_manifests(spark, d):
    m = RUNS.read_manifests(spark, f"{_manifest_path(spark, d)}/*/*.json")
    return m.select("run_id", "movetime_ms", "total_puzzles", "concurrency",
                    F.array_join("engines", ",").alias("engines"), "min_rating", "use_wandb")


@query("register_runs", """
SELECT run_id, CAST(COUNT(DISTINCT puzzle_id) AS INTEGER) AS total_puzzles FROM fx_evals
WHERE run_id NOT IN ('run_a') GROUP BY run_id""")
def q_register_runs(spark, d):
    manifests = _manifest_rows(spark, d)
    path = scratch_path(spark, "registered")
    K.write_manifests(manifests.where(F.col("run_id") == "run_a").withColumn("total_puzzles", F.lit(-1)), path)
    K.write_manifests(manifests, path)          # run_a is there already: its document stays
    back = spark.read.schema(manifests.schema).json(path)
    return back.where(F.col("total_puzzles") >= 0).select("run_id", "total_puzzles")


@query("src_checkpoints", f"""
SELECT run_id, engine, puzzle_id, is_correct, CAST(depth AS BIGINT) AS depth,
       CAST(COUNT(*) OVER (PARTITION BY run_id, engine, CAST(floor(pos / {SHARD}) AS BIGINT)) AS INTEGER) AS last_index
FROM fx_evals""")
def q_src_checkpoints(spark, d):
    ev = fx.fx_evals(spark, d).withColumn("shard", F.floor(F.col("pos") / SHARD).cast("bigint"))
    cols = [f.name for f in RUNS.RESULT_SCHEMA.fields if f.name in ev.columns]
    # a checkpoint holds one shard's results: a bounded group
    docs = ev.groupBy("run_id", "engine", "shard").agg(
        F.count(F.lit(1)).cast("int").alias("last_index"),
        F.collect_list(F.struct(*[F.col(c).cast(RUNS.RESULT_SCHEMA[c].dataType).alias(c) for c in cols])).alias("results"))
    path = scratch_path(spark, "checkpoints")
    docs.select("run_id", "last_index", "results").write.mode("overwrite").json(path)
    spark.createDataFrame([('{"run_id": "run_a", "last_index": 7, "results": [',)], "value string") \
         .write.mode("append").text(path)          # an interrupted write: unreadable, ignored
    ck = RUNS.read_checkpoints(spark, path)
    return ck.select("run_id", "engine", "puzzle_id", "is_correct", "depth", "last_index")


@query("parse_transcript", """
SELECT run_id || '__' || engine_id AS session,
       row_number() OVER (PARTITION BY run_id, engine_id ORDER BY pos) AS position,
       engine_move AS bestmove, depth, CAST(CAST(nps AS BIGINT) AS DOUBLE) AS nps
FROM fx_answers
UNION ALL
SELECT run_id || '__' || engine_id, COUNT(*) + 1, '', 3, 77.0::DOUBLE FROM fx_answers
WHERE engine_id <> 'lc0_v0_32_1' GROUP BY run_id, engine_id
UNION ALL
SELECT run_id || '__' || engine_id, COUNT(*) + 2, '', 0, 0.0::DOUBLE FROM fx_answers
WHERE engine_id = 'stockfish_18' AND run_id = 'run_b' GROUP BY run_id, engine_id""")
def q_parse_transcript(spark, d):
    a = fx.fx_answers(spark, d)
    session = F.concat(F.col("run_id"), F.lit("__"), F.col("engine_id"))
    npsi = F.col("nps").cast("bigint").cast("string")
    # the sessions of run_b were logged with their questions
    asks = F.when(F.col("run_id") == "run_b", F.lit("go movetime 2000")).otherwise(F.lit("info string thinking"))
    lines = F.array(
        F.struct(F.lit(0).alias("k"), F.concat(F.lit("info string position "), F.col("puzzle_id")).alias("line")),
        F.struct(F.lit(1).alias("k"), asks.alias("line")),
        F.struct(F.lit(2).alias("k"), F.format_string("info depth %d seldepth %d nps %d", F.col("depth") - 2,
                                                        F.col("depth"), (F.col("nps") / 2).cast("bigint")).alias("line")),
        F.struct(F.lit(3).alias("k"), F.concat(F.lit("info depth "), F.col("depth").cast("string"),
                                               F.lit(" score cp 31 nodes 1000 nps "), npsi, F.lit(" pv "),
                                               F.col("engine_move")).alias("line")),
        F.struct(F.lit(4).alias("k"), F.lit("info depth x12 nps fast").alias("line")),
        F.struct(F.lit(5).alias("k"), F.concat(F.lit("bestmove "), F.col("engine_move"), F.lit(" ponder e7e5")).alias("line")))
    t = a.select(session.alias("session"), "pos", F.inline(lines))
    # all but one engine stop in the middle of a further position; one is asked again and says nothing; all end with some text
    ends = a.select("run_id", "engine_id", session.alias("session")).distinct()
    others, asked = F.col("engine_id") != "lc0_v0_32_1", F.col("run_id") == "run_b"
    tail = F.array(
        F.struct(F.lit(1).alias("k"), F.when(others & asked, F.lit("go movetime 2000")).alias("line")),
        F.struct(F.lit(2).alias("k"), F.when(others, F.lit("info depth 3 seldepth 4 nps 77")).alias("line")),
        F.struct(F.lit(3).alias("k"), F.when((F.col("engine_id") == "stockfish_18") & asked, F.lit("go movetime 2000")).alias("line")),
        F.struct(F.lit(4).alias("k"), F.lit("info string bye").alias("line")))
    t = t.unionByName(ends.select("session", F.lit(1 << 40).cast("long").alias("pos"), F.inline(tail)).where("line IS NOT NULL"))

    def write(path):
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (t.repartitionByRange(n, "session", "pos", "k").sortWithinPartitions("session", "pos", "k")
         .select("session", F.col("line").alias("value")).write.mode("overwrite").partitionBy("session").text(path))
    path = landed(spark, f"transcripts:{d}", write)
    return parse_transcript(read_transcripts(spark, path))


@query("engine_rollup_3nf_export", """
SELECT e.engine_name AS engine, COUNT(*) AS total_puzzles,
       CAST(SUM(CASE WHEN v.is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       ROUND(AVG(CASE WHEN v.is_correct THEN 1.0 ELSE 0.0 END) * 100.0, 2) AS accuracy_pct,
       ROUND(AVG(v.nps), 0) AS avg_nps, ROUND(AVG(v.depth), 1) AS avg_depth,
       ROUND(AVG(v.elapsed_seconds), 3) AS avg_sec_per_pos, ROUND(AVG(v.rating), 0) AS avg_puzzle_rating
FROM fx_evals v JOIN fx_engines e ON v.engine_id = e.engine_id GROUP BY e.engine_name""")
def q_engine_rollup_3nf_export(spark, d):
    path = _results_path(spark, d)
    back = spark.read.parquet(path)
    eng = fx.fx_engines(spark).select("engine_id", F.col("engine_name"))
    j = back.join(bounded_broadcast(eng), "engine_id").drop("engine").withColumnRenamed("engine_name", "engine")
    return R.engine_rollup(j).select("engine", "total_puzzles", "solved", "accuracy_pct", "avg_nps",
                                     "avg_depth", "avg_sec_per_pos", "avg_puzzle_rating")

