"""Registered queries: scoring, resume, shard reports, running accuracy, limits, set ops."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import scoring as S
from ..session import scratch_path
from ..sources import runs as RUNS
from . import fixtures as fx
from .registry import query

SHARD_SIZE = 20          # puzzles per shard in the shard-level fixtures
MIN_RATING_HARD = 2900   # rating filter of the shard report
RESUME_RATING, RESUME_MOST, RESUME_INDEX = 1300, 15, 7   # rating filter, rows of a shard, row of the interruption


def _with_shard(df):
    return df.withColumn("shard", F.floor(F.col("pos") / SHARD_SIZE).cast("bigint"))


@query("score_answers", """
SELECT a.run_id, a.puzzle_id, z.fen, z.solution, a.engine_move,
       COALESCE(a.engine_move = z.solution, false) AS is_correct,
       a.depth, a.nps, a.elapsed_seconds, z.rating, a.engine,
       replace(replace(lower(a.engine), ' ', '_'), '.', '_') AS engine_id
FROM fx_answers a JOIN fx_puzzles z ON a.puzzle_id = z.puzzle_id""")
def q_score_answers(spark, d):
    answers = fx.fx_answers(spark, d).drop("pos", "engine_id")
    return S.score_answers(fx.fx_puzzles(spark, d), answers)


@query("resume_pending", """
SELECT w.run_id, w.engine, w.puzzle_id FROM fx_answers w
WHERE NOT EXISTS (SELECT 1 FROM fx_answers d
                  WHERE d.elapsed_seconds < 0.2 AND d.run_id = w.run_id
                    AND d.engine = w.engine AND d.puzzle_id = w.puzzle_id)""")
def q_resume_pending(spark, d):
    a = fx.fx_answers(spark, d)
    work = a.select("run_id", "engine", "puzzle_id")
    done = a.where(F.col("elapsed_seconds") < 0.2)   # results persisted before the interruption
    return S.resume_pending(work, done)


RESUME = f"""rows AS (
  SELECT run_id, engine_id, shard, puzzle_id, engine_move, is_correct, pos,
         row_number() OVER (PARTITION BY run_id, engine_id, shard ORDER BY pos) - 1 AS index
  FROM (SELECT *, CAST(floor(pos / {SHARD_SIZE}) AS BIGINT) AS shard FROM fx_evals WHERE rating >= {RESUME_RATING}) t),
cut AS (SELECT * FROM rows WHERE index < {RESUME_MOST}),
state AS (SELECT *, run_id = 'run_a' AND shard % 3 = 0 AS saved, run_id = 'run_b' AND shard % 5 = 4 AS done FROM cut)"""


@query("resume_from_checkpoints", f"""
WITH {RESUME}
SELECT run_id, engine_id, shard, index, puzzle_id, CASE WHEN saved AND index < {RESUME_INDEX} THEN 'saved' ELSE engine_move END AS engine_move,
       CASE WHEN saved AND index < {RESUME_INDEX} THEN false ELSE is_correct END AS is_correct, saved AND index < {RESUME_INDEX} AS recovered
FROM state WHERE NOT done""")
def q_resume_from_checkpoints(spark, d):
    """Interrupted at row 7 in every third shard of run_a, broken checkpoints in the shards behind these; some shards of run_b are done."""
    evals = _with_shard(fx.fx_evals(spark, d))
    place = Window.partitionBy("run_id", "engine_id", "shard").orderBy("pos")
    numbered = evals.where(F.col("rating") >= RESUME_RATING).withColumn("index", F.row_number().over(place) - 1)
    saved = numbered.where((F.col("run_id") == "run_a") & (F.col("shard") % 3 == 0) & (F.col("index") < RESUME_INDEX))
    result = F.struct("run_id", "puzzle_id", F.lit("saved").alias("engine_move"), F.lit(False).alias("is_correct"))
    docs = saved.groupBy("run_id", "engine_id", "shard").agg(
        F.lit(RESUME_INDEX).alias("last_index"), F.transform(F.array_sort(F.collect_list(F.struct("index", result.alias("r")))), lambda x: x["r"]).alias("results"))
    path = scratch_path(spark, "resume")
    # a folder an engine, the checkpoints of many shards in a file
    docs.write.mode("overwrite").partitionBy("engine_id").json(path)
    broken = evals.where((F.col("run_id") == "run_a") & (F.col("shard") % 3 == 1)).select(
        "engine_id", F.concat(F.lit('{"run_id": "run_a", "shard": '), F.col("shard").cast("string"), F.lit(', "last_index": 9, "results": [')).alias("value")).distinct()
    broken.write.mode("append").partitionBy("engine_id").text(path)
    state = RUNS.read_checkpoint_state(spark, path)
    plan = evals.select("run_id", "engine_id", "shard").distinct()
    done = plan.where((F.col("run_id") == "run_b") & (F.col("shard") % 5 == 4))
    work = S.resume_rows(_with_shard(fx.fx_puzzles(spark, d)), plan, state, done, RESUME_RATING, RESUME_MOST)
    # a row for each puzzle, engine and run: by the size of the part file the planner would send all of them through the driver
    answers = fx.fx_answers(spark, d).select("run_id", "engine_id", "puzzle_id", "engine_move").hint("merge")
    fresh = (work.select("run_id", "engine_id", "shard", "index", "puzzle_id", "solution").join(answers, ["run_id", "engine_id", "puzzle_id"])
             .withColumn("is_correct", C.is_correct("engine_move", "solution")).drop("solution"))
    out = S.resumed_results(RUNS.checkpoint_results(state), fresh)
    return out.select("run_id", "engine_id", "shard", "index", "puzzle_id", "engine_move", "is_correct", "recovered")


@query("filter_engines", """
SELECT run_id, puzzle_id, engine, is_correct FROM fx_evals
WHERE engine IN ('Stockfish 18', 'Lc0 v0.32.1')""")
def q_filter_engines(spark, d):
    ev = fx.fx_evals(spark, d).select("run_id", "puzzle_id", "engine", "is_correct")
    return S.filter_engines(ev, " Stockfish 18 ,, Lc0 v0.32.1 ")


@query("filter_engines_table", """
SELECT run_id, puzzle_id, engine, is_correct FROM fx_evals
WHERE engine IN ('Reckless 0.9.0', 'Pawnocchio 2.0.1')""")
def q_filter_engines_table(spark, d):
    ev = fx.fx_evals(spark, d).select("run_id", "puzzle_id", "engine", "is_correct")
    sel = spark.createDataFrame([("Reckless 0.9.0, Pawnocchio 2.0.1,",)], "spec string")
    return S.filter_engines_by_table(ev, sel)


@query("solved_positions", """
SELECT puzzle_id, rating, engine, depth, nps, elapsed_seconds FROM fx_evals WHERE is_correct = true""")
def q_solved_positions(spark, d):
    return S.solved_positions(fx.fx_evals(spark, d))


@query("shard_report", f"""
WITH plan AS (
  SELECT DISTINCT run_id, engine, CAST(floor(pos / {SHARD_SIZE}) AS BIGINT) AS shard FROM fx_answers),
ev AS (
  SELECT run_id, engine, CAST(floor(pos / {SHARD_SIZE}) AS BIGINT) AS shard, COUNT(*) AS total,
         CAST(SUM(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved
  FROM fx_evals WHERE rating >= {MIN_RATING_HARD} GROUP BY 1, 2, 3),
done AS (SELECT DISTINCT run_id, engine, shard FROM plan WHERE run_id = 'run_a' AND shard < 10)
SELECT p.run_id, p.engine, p.shard,
       CASE WHEN dn.shard IS NOT NULL THEN 'already_done'
            WHEN COALESCE(ev.total, 0) = 0 THEN 'empty' ELSE 'completed' END AS status,
       CASE WHEN dn.shard IS NULL THEN ev.total END AS total,
       CASE WHEN dn.shard IS NULL THEN ev.solved END AS solved,
       CASE WHEN dn.shard IS NULL THEN ROUND(ev.solved * 100.0 / ev.total, 2) END AS accuracy_pct
FROM plan p
LEFT JOIN done dn ON dn.run_id = p.run_id AND dn.engine = p.engine AND dn.shard = p.shard
LEFT JOIN ev ON ev.run_id = p.run_id AND ev.engine = p.engine AND ev.shard = p.shard""")
def q_shard_report(spark, d):
    ev = _with_shard(fx.fx_evals(spark, d))
    plan = _with_shard(fx.fx_answers(spark, d)).select("run_id", "engine", "shard").distinct()
    done = plan.where((F.col("run_id") == "run_a") & (F.col("shard") < 10))
    return S.shard_report(plan, ev, done, min_rating=MIN_RATING_HARD)


@query("running_accuracy", """
SELECT event_type AS engine, event_id,
       row_number() OVER w AS processed,
       CAST(SUM(CASE WHEN value >= 100 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS solved_so_far,
       ROUND((SUM(CASE WHEN value >= 100 THEN 1 ELSE 0 END) OVER w) * 100.0 / (row_number() OVER w), 2) AS running_accuracy_pct
FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_running_accuracy(spark, d):
    ev = fx.table(spark, d, "events").select(F.col("event_type").alias("engine"), "event_id", "ts",
                                             (F.col("value") >= 100).alias("is_correct"))
    r = S.running_accuracy(ev, by=("engine",), order=("ts", "event_id"))
    return r.select("engine", "event_id", "processed", "solved_so_far", "running_accuracy_pct")


@query("limit_per_engine", f"""
SELECT run_id, engine, puzzle_id, taken FROM (
  SELECT run_id, engine, puzzle_id,
         row_number() OVER (PARTITION BY run_id, engine ORDER BY CAST(floor(pos / {SHARD_SIZE}) AS BIGINT), pos) AS taken
  FROM fx_evals) t
WHERE taken <= 500""")
def q_limit_per_engine(spark, d):
    ev = _with_shard(fx.fx_evals(spark, d)).select("run_id", "engine", "puzzle_id", "shard", "pos")
    return S.limit_per_engine(ev, 500).select("run_id", "engine", "puzzle_id", "taken")


@query("slice_shard", f"""
SELECT puzzle_id, shard, row_in_shard FROM (
  SELECT puzzle_id, CAST(floor(pos / {SHARD_SIZE}) AS BIGINT) AS shard,
         row_number() OVER (PARTITION BY CAST(floor(pos / {SHARD_SIZE}) AS BIGINT) ORDER BY pos) - 1 AS row_in_shard
  FROM fx_puzzles) t
WHERE row_in_shard < 5""")
def q_slice_shard(spark, d):
    z = _with_shard(fx.fx_puzzles(spark, d))
    return S.slice_shard(z, 5).select("puzzle_id", "shard", "row_in_shard")


@query("union_results", """
SELECT run_id, puzzle_id, engine, is_correct, rating FROM fx_evals WHERE run_id = 'run_a'
UNION ALL BY NAME
SELECT run_id, puzzle_id, engine, is_correct FROM fx_evals WHERE run_id = 'run_b'""")
def q_union_results(spark, d):
    ev = fx.fx_evals(spark, d)
    recovered = ev.where(F.col("run_id") == "run_a").select("run_id", "puzzle_id", "engine", "is_correct", "rating")
    new = ev.where(F.col("run_id") == "run_b").select("run_id", "puzzle_id", "engine", "is_correct")
    return S.union_results(recovered, new)


@query("union_ids", """
SELECT puzzle_id FROM fx_evals WHERE engine = 'Stockfish 18' AND is_correct
UNION
SELECT puzzle_id FROM fx_evals WHERE engine = 'Lc0 v0.32.1' AND is_correct""")
def q_union_ids(spark, d):
    ev = fx.fx_evals(spark, d)
    a = ev.where((F.col("engine") == "Stockfish 18") & F.col("is_correct"))
    b = ev.where((F.col("engine") == "Lc0 v0.32.1") & F.col("is_correct"))
    return S.union_ids(a, b)


@query("stored_count", """
SELECT COUNT(DISTINCT puzzle_id) AS stored FROM fx_answers""")
def q_stored_count(spark, d):
    return S.stored_count(fx.fx_answers(spark, d))
