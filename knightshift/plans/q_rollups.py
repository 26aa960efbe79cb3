"""Registered queries: rollups and the joins feeding them."""

from __future__ import annotations

from ..operators import rollups as R
from . import fixtures as fx
from .registry import query

ROLLUP_ORDERED = """
SELECT engine, COUNT(*) AS total_puzzles,
       CAST(SUM(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       ROUND(AVG(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) * 100.0, 2) AS accuracy_pct,
       ROUND(AVG(nps), 0) AS avg_nps, ROUND(AVG(depth), 1) AS avg_depth,
       ROUND(AVG(elapsed_seconds), 3) AS avg_sec_per_pos, ROUND(AVG(rating), 0) AS avg_puzzle_rating
FROM fx_evals GROUP BY engine ORDER BY accuracy_pct DESC, avg_nps DESC
"""


@query("engine_rollup", ROLLUP_ORDERED)
def q_engine_rollup(spark, d):
    return R.engine_rollup(fx.fx_evals(spark, d))


@query("engine_rollup_by_run", """
SELECT run_id, engine, COUNT(*) AS total_puzzles,
       CAST(SUM(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       ROUND(AVG(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) * 100.0, 2) AS accuracy_pct,
       ROUND(AVG(nps), 0) AS avg_nps, ROUND(AVG(depth), 1) AS avg_depth,
       ROUND(AVG(elapsed_seconds), 3) AS avg_sec_per_pos, ROUND(AVG(rating), 0) AS avg_puzzle_rating
FROM fx_evals GROUP BY run_id, engine""")
def q_engine_rollup_by_run(spark, d):
    return R.engine_rollup(fx.fx_evals(spark, d), by=("run_id", "engine"))


@query("telemetry_rollup", """
SELECT engine, COUNT(*) AS total_puzzles,
       CAST(SUM(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       ROUND(AVG(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) * 100.0, 2) AS accuracy_pct,
       ROUND(AVG(nps), 0) AS avg_nps, ROUND(AVG(depth), 1) AS avg_depth,
       ROUND(AVG(elapsed_seconds), 3) AS avg_sec, ROUND(SUM(elapsed_seconds), 1) AS total_sec
FROM fx_evals GROUP BY engine ORDER BY accuracy_pct DESC, avg_nps DESC""")
def q_telemetry_rollup(spark, d):
    return R.telemetry_rollup(fx.fx_evals(spark, d))


@query("export_rollup", """
SELECT engine, COUNT(*) AS total_puzzles,
       CAST(SUM(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       ROUND(AVG(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy_pct,
       ROUND(AVG(nps), 0) AS avg_nps, ROUND(AVG(depth), 1) AS avg_depth,
       ROUND(AVG(elapsed_seconds), 3) AS avg_sec_per_pos
FROM fx_evals GROUP BY engine ORDER BY accuracy_pct DESC""")
def q_export_rollup(spark, d):
    return R.rollup(fx.fx_evals(spark, d), measures=R.EXPORT_ROLLUP)


@query("export_rollup_short", """
SELECT engine, COUNT(*) AS n,
       ROUND(AVG(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) * 100, 2) AS acc_pct,
       ROUND(AVG(nps), 0) AS avg_nps, ROUND(AVG(depth), 1) AS avg_depth
FROM fx_evals GROUP BY engine""")
def q_export_rollup_short(spark, d):
    return R.rollup(fx.fx_evals(spark, d), measures=R.EXPORT_ROLLUP_SHORT, order=False)


@query("export_rollup_doc", """
SELECT engine, COUNT(*) AS n, CAST(SUM(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       ROUND(AVG(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) * 100, 2) AS acc_pct,
       ROUND(AVG(nps), 0) AS avg_nps, ROUND(AVG(depth), 1) AS avg_depth,
       ROUND(AVG(elapsed_seconds), 3) AS avg_sec
FROM fx_evals GROUP BY engine ORDER BY acc_pct DESC""")
def q_export_rollup_doc(spark, d):
    return R.rollup(fx.fx_evals(spark, d), measures=R.EXPORT_ROLLUP_DOC)


@query("mini_rollup", """
SELECT engine, COUNT(*) AS total,
       ROUND(AVG(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy_pct
FROM fx_evals GROUP BY engine""")
def q_mini_rollup(spark, d):
    return R.rollup(fx.fx_evals(spark, d), measures=R.MINI_ROLLUP, order=False)


@query("rollup_3nf", """
SELECT e.engine_name, COUNT(*) AS total,
       CAST(SUM(CASE WHEN pe.is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       ROUND(AVG(CASE WHEN pe.is_correct THEN 1.0 ELSE 0.0 END) * 100.0, 2) AS accuracy_pct
FROM fx_evals pe JOIN fx_engines e ON pe.engine_id = e.engine_id
WHERE pe.run_id = 'run_a'
GROUP BY e.engine_name ORDER BY accuracy_pct DESC""")
def q_rollup_3nf(spark, d):
    return R.rollup_3nf(fx.fx_evals(spark, d), fx.fx_engines(spark), "run_a")


@query("accuracy_by_theme", """
WITH bridge AS (
  SELECT DISTINCT puzzle_id, theme_id FROM (
    SELECT puzzle_id, unnest(regexp_split_to_array(trim(themes), '\\s+')) AS theme_id FROM fx_puzzles) b
  WHERE theme_id <> ''),
per_puzzle AS (
  SELECT puzzle_id, COUNT(*) AS n, SUM(CASE WHEN is_correct THEN 1 ELSE 0 END) AS s
  FROM fx_evals GROUP BY puzzle_id)
SELECT theme_id, CAST(SUM(n) AS BIGINT) AS evaluations, CAST(SUM(s) AS BIGINT) AS solved,
       ROUND(CAST(SUM(s) AS DOUBLE) * 100.0 / CAST(SUM(n) AS DOUBLE), 2) AS accuracy_pct
FROM per_puzzle JOIN bridge USING (puzzle_id) GROUP BY theme_id""")
def q_accuracy_by_theme(spark, d):
    return R.accuracy_by_theme(fx.fx_evals(spark, d), fx.fx_puzzles(spark, d))


@query("theme_bridge", """
SELECT DISTINCT puzzle_id, theme_id FROM (
  SELECT puzzle_id, unnest(regexp_split_to_array(trim(themes), '\\s+')) AS theme_id FROM fx_puzzles) b
WHERE theme_id <> ''""")
def q_theme_bridge(spark, d):
    return R.theme_bridge(fx.fx_puzzles(spark, d))


@query("rollup_by_movetime", """
SELECT e.engine, r.movetime_ms, COUNT(*) AS total,
       CAST(SUM(CASE WHEN e.is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       ROUND(AVG(CASE WHEN e.is_correct THEN 1.0 ELSE 0.0 END) * 100.0, 2) AS accuracy_pct,
       ROUND(AVG(e.elapsed_seconds), 3) AS avg_sec
FROM fx_evals e JOIN fx_runs r ON e.run_id = r.run_id GROUP BY e.engine, r.movetime_ms""")
def q_rollup_by_movetime(spark, d):
    return R.rollup_by_movetime(fx.fx_evals(spark, d), fx.fx_runs(spark))


@query("engine_agreement", """
SELECT a.engine AS engine_a, b.engine AS engine_b, COUNT(*) AS positions,
       CAST(SUM(CASE WHEN a.engine_move = b.engine_move THEN 1 ELSE 0 END) AS BIGINT) AS agreements,
       ROUND(SUM(CASE WHEN a.engine_move = b.engine_move THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 2) AS agreement_pct
FROM fx_evals a JOIN fx_evals b ON a.run_id = b.run_id AND a.puzzle_id = b.puzzle_id AND a.engine < b.engine
GROUP BY a.engine, b.engine""")
def q_engine_agreement(spark, d):
    return R.engine_agreement(fx.fx_evals(spark, d))


@query("depth_histogram", """
SELECT engine, depth, COUNT(*) AS n FROM fx_evals GROUP BY engine, depth""")
def q_depth_histogram(spark, d):
    return R.depth_histogram(fx.fx_evals(spark, d))


@query("depth_percentiles", """
SELECT engine, COUNT(*) AS n,
       quantile_disc(depth, 0.25) AS p25, quantile_disc(depth, 0.5) AS p50,
       quantile_disc(depth, 0.75) AS p75, quantile_disc(depth, 0.9) AS p90
FROM fx_evals GROUP BY engine""")
def q_depth_percentiles(spark, d):
    return R.depth_percentiles(fx.fx_evals(spark, d))


@query("engine_ids", """
SELECT DISTINCT engine, replace(replace(lower(engine), ' ', '_'), '.', '_') AS engine_id FROM fx_answers""")
def q_engine_ids(spark, d):
    return R.engine_ids(fx.fx_answers(spark, d).select("engine"))
