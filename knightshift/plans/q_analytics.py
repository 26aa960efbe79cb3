"""Registered queries: move analytics, game facts, relational checks, telemetry and
report texts (W7, A12, A13, A15, J8, J9, C1-C5, K7, P19-P21, P23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import columns as C
from ..operators import moves as MV
from ..operators import quality as Q
from ..operators import rollups as R
from ..operators import telemetry as T
from . import fixtures as fx
from .model_fixture import checks_sql, model_tables
from .registry import query

LOSS_SQL = """loss AS (
  SELECT game_id, ply, turn, eval_cp, best_cp,
         eval_cp - lag(eval_cp) OVER (PARTITION BY game_id ORDER BY ply) AS eval_swing,
         greatest(0, CASE WHEN turn = 'w' THEN best_cp - eval_cp ELSE eval_cp - best_cp END) AS centipawn_loss
  FROM fx_moves)"""


@query("centipawn_loss", f"WITH {LOSS_SQL} SELECT game_id, ply, eval_swing, centipawn_loss FROM loss")
def q_centipawn_loss(spark, d):
    return MV.centipawn_loss(fx.fx_moves(spark, d)).select("game_id", "ply", "eval_swing", "centipawn_loss")


@query("acpl", f"""WITH {LOSS_SQL}
SELECT game_id, turn, AVG(centipawn_loss) AS acpl, COUNT(*) AS moves FROM loss GROUP BY game_id, turn""")
def q_acpl(spark, d):
    return MV.acpl(MV.centipawn_loss(fx.fx_moves(spark, d)))


@query("judgments", f"""WITH {LOSS_SQL}
SELECT turn,
       COUNT(*) FILTER (WHERE centipawn_loss < 50) AS best,
       COUNT(*) FILTER (WHERE centipawn_loss >= 50 AND centipawn_loss < 100) AS inaccuracy,
       COUNT(*) FILTER (WHERE centipawn_loss >= 100 AND centipawn_loss < 300) AS mistake,
       COUNT(*) FILTER (WHERE centipawn_loss >= 300) AS blunder
FROM loss GROUP BY turn""")
def q_judgments(spark, d):
    return MV.judgment_counts(MV.centipawn_loss(fx.fx_moves(spark, d)))


FACTS_SQL = """facts AS (
  SELECT g.game_id, g.result, w.display_name AS white_name, b.display_name AS black_name, o.opening_name
  FROM fx_games g
  LEFT JOIN fx_players w ON w.player_id = g.white_player_id
  LEFT JOIN fx_players b ON b.player_id = g.black_player_id
  LEFT JOIN fx_openings o ON o.eco_key = g.eco_key)"""


@query("game_facts", f"WITH {FACTS_SQL} SELECT * FROM facts")
def q_game_facts(spark, d):
    f = MV.game_facts(fx.fx_games(spark, d), fx.fx_players(spark, d), fx.fx_openings(spark, d))
    return f.select("game_id", "result", "white_name", "black_name", "opening_name")


@query("move_facts", """
SELECT m.game_id, m.ply, m.move_san, m.eval_cp, g.white, g.black, g.result
FROM fx_moves m JOIN fx_games g ON m.game_id = g.game_id""")
def q_move_facts(spark, d):
    m = fx.fx_moves(spark, d).select("game_id", "ply", "move_san", "eval_cp")
    return MV.move_facts(fx.fx_games(spark, d), m)


@query("results_by_opening", f"""WITH {FACTS_SQL}
SELECT opening_name, COUNT(*) AS games, COUNT(*) FILTER (WHERE result = '1-0') AS white_wins,
       COUNT(*) FILTER (WHERE result = '1/2-1/2') AS draws, COUNT(*) FILTER (WHERE result = '0-1') AS black_wins
FROM facts GROUP BY opening_name""")
def q_results_by_opening(spark, d):
    f = MV.game_facts(fx.fx_games(spark, d), fx.fx_players(spark, d), fx.fx_openings(spark, d))
    return MV.results_by_opening(f)


@query("results_by_player", """
WITH s AS (
  SELECT white_player_id AS player_id,
         CASE result WHEN '1-0' THEN 1.0::DOUBLE WHEN '1/2-1/2' THEN 0.5::DOUBLE WHEN '0-1' THEN 0.0::DOUBLE END AS pts FROM fx_games
  UNION ALL
  SELECT black_player_id,
         CASE result WHEN '0-1' THEN 1.0::DOUBLE WHEN '1/2-1/2' THEN 0.5::DOUBLE WHEN '1-0' THEN 0.0::DOUBLE END FROM fx_games),
per AS (SELECT player_id, COUNT(*) AS games, SUM(pts) AS points FROM s GROUP BY player_id)
SELECT per.player_id, per.games, per.points, p.display_name
FROM per LEFT JOIN fx_players p ON p.player_id = per.player_id""")
def q_results_by_player(spark, d):
    return MV.results_by_player(fx.fx_games(spark, d), fx.fx_players(spark, d))


def _pk_sql(table: str, src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    nul = " OR ".join(f"{c} IS NULL" for c in keys)
    return f"""SELECT '{table}' AS table_name, '{",".join(keys)}' AS key_columns,
       COUNT(*) FILTER (WHERE n > 1) AS duplicate_keys,
       CAST(COALESCE(SUM(CASE WHEN nul THEN n END), 0) AS BIGINT) AS null_key_rows
FROM (SELECT {k}, COUNT(*) AS n, bool_or({nul}) AS nul FROM {src} GROUP BY {k}) t"""


PK_CHECKS = [
    ("puzzles", "fx_puzzles", ["puzzle_id"]),
    ("puzzle_evaluations", "fx_evals", ["run_id", "puzzle_id", "engine_id"]),
    ("games", "fx_games", ["game_id"]),
    ("game_moves", "fx_moves", ["game_id", "ply"]),
    ("move_lines", "lineitem", ["l_orderkey", "l_linenumber"]),
]


@query("check_pk", "\nUNION ALL\n".join(_pk_sql(t, s, k) for t, s, k in PK_CHECKS))
def q_check_pk(spark, d):
    srcs = {"fx_puzzles": fx.fx_puzzles(spark, d), "fx_evals": fx.fx_evals(spark, d),
            "fx_games": fx.fx_games(spark, d), "fx_moves": fx.fx_moves(spark, d),
            "lineitem": fx.table(spark, d, "lineitem")}
    return Q.union_all([Q.check_pk(srcs[s], k, t) for t, s, k in PK_CHECKS])


FK_CHECKS = [
    ("puzzle_evaluations.puzzle_id", "fx_evals", "puzzle_id", "fx_puzzles", "puzzle_id"),
    ("puzzle_evaluations.engine_id", "fx_evals", "engine_id", "fx_engines", "engine_id"),
    ("puzzle_evaluations.run_id", "fx_evals", "run_id", "fx_runs", "run_id"),
    ("game_moves.game_id", "fx_moves", "game_id", "fx_games", "game_id"),
    ("games.white_player_id", "fx_games", "white_player_id", "fx_players", "player_id"),
    ("games.black_player_id", "fx_games", "black_player_id", "fx_players", "player_id"),
    ("games.eco", "fx_games", "eco_key", "fx_openings", "eco_key"),
]


def _fk_sql(name, child, col, parent, pcol):
    return f"""SELECT '{name}' AS foreign_key, COUNT(*) AS orphan_rows, COUNT(DISTINCT c.{col}) AS orphan_keys
FROM {child} c WHERE c.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pcol} = c.{col})"""


@query("check_fk", "\nUNION ALL\n".join(_fk_sql(*c) for c in FK_CHECKS))
def q_check_fk(spark, d):
    srcs = {"fx_evals": fx.fx_evals(spark, d), "fx_puzzles": fx.fx_puzzles(spark, d),
            "fx_engines": fx.fx_engines(spark), "fx_runs": fx.fx_runs(spark), "fx_moves": fx.fx_moves(spark, d),
            "fx_games": fx.fx_games(spark, d), "fx_players": fx.fx_players(spark, d),
            "fx_openings": fx.fx_openings(spark, d)}
    return Q.union_all([Q.check_fk(srcs[c], col, srcs[p], pc, n) for n, c, col, p, pc in FK_CHECKS])


NN_CHECKS = [
    ("puzzle_evaluations", "fx_evals", ["run_id", "puzzle_id", "engine_id", "engine_move", "is_correct",
                                        "depth", "nps", "elapsed_seconds"]),
    ("games", "fx_games", ["game_id", "white_player_id", "black_player_id", "result"]),
    ("game_moves", "fx_moves", ["game_id", "ply", "turn", "move_san"]),
]


@query("check_not_null", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {s}"
    for t, s, cols in NN_CHECKS for c in cols))
def q_check_not_null(spark, d):
    srcs = {"fx_evals": fx.fx_evals(spark, d), "fx_games": fx.fx_games(spark, d), "fx_moves": fx.fx_moves(spark, d)}
    return Q.union_all([Q.check_not_null(srcs[s], cols, t) for t, s, cols in NN_CHECKS])


LEN_CHECKS = [
    ("puzzle_evaluations", "fx_evals", {"engine_move": 5}),
    ("puzzles", "fx_puzzles", {"solution": 5, "solution_san": 10}),
    ("games", "fx_games", {"result": 7}),
    ("game_moves", "fx_moves", {"turn": 1, "move_san": 10}),
]


@query("check_length", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {n} AS max_allowed, CAST(MAX(length({c})) AS INTEGER) AS max_length, "
    f"COUNT(*) FILTER (WHERE length({c}) > {n}) AS violations FROM {s}"
    for t, s, lim in LEN_CHECKS for c, n in lim.items()))
def q_check_length(spark, d):
    srcs = {"fx_evals": fx.fx_evals(spark, d), "fx_puzzles": fx.fx_puzzles(spark, d),
            "fx_games": fx.fx_games(spark, d), "fx_moves": fx.fx_moves(spark, d)}
    return Q.union_all([Q.check_length(srcs[s], lim, t) for t, s, lim in LEN_CHECKS])


@query("check_model", checks_sql())
def q_check_model(spark, d):
    """Every constraint of the twelve tables, over rows that break them."""
    return Q.check_model(model_tables(spark, d))


@query("normalize_evals", """
SELECT DISTINCT replace(replace(lower(engine), ' ', '_'), '.', '_') AS engine_id, engine AS engine_name,
       CASE WHEN contains(lower(engine), 'lc0') OR contains(lower(engine), 'leela') THEN 'lc0'
            WHEN contains(lower(engine), 'stockfish') THEN 'stockfish'
            WHEN contains(lower(engine), 'reckless') THEN 'reckless'
            WHEN contains(lower(engine), 'pawnocchio') THEN 'pawnocchio' ELSE 'other' END AS family
FROM fx_evals""")
def q_normalize_evals(spark, d):
    return Q.normalize_engines(fx.fx_evals(spark, d))


@query("normalize_evaluations", """
SELECT run_id, puzzle_id, replace(replace(lower(engine), ' ', '_'), '.', '_') AS engine_id, engine_move,
       is_correct, depth, nps, elapsed_seconds FROM fx_evals""")
def q_normalize_evaluations(spark, d):
    return Q.normalize_evaluations(fx.fx_evals(spark, d))


@query("engine_family", """
SELECT c_name AS name, 'other' AS family FROM customer
UNION ALL
SELECT engine_name, CASE WHEN contains(lower(engine_name), 'lc0') OR contains(lower(engine_name), 'leela') THEN 'lc0'
            WHEN contains(lower(engine_name), 'stockfish') THEN 'stockfish'
            WHEN contains(lower(engine_name), 'reckless') THEN 'reckless'
            WHEN contains(lower(engine_name), 'pawnocchio') THEN 'pawnocchio' ELSE 'other' END FROM fx_engines""")
def q_engine_family(spark, d):
    names = fx.table(spark, d, "customer").select(F.col("c_name").alias("name")).unionByName(
        fx.fx_engines(spark).select(F.col("engine_name").alias("name")))
    return names.select("name", C.engine_family("name").alias("family"))


@query("apply_defaults", """
SELECT puzzle_id, rating, 100 AS popularity, 0 AS nb_plays FROM fx_puzzles""")
def q_apply_defaults(spark, d):
    z = fx.fx_puzzles(spark, d).select("puzzle_id", "rating")
    return Q.apply_defaults(z, "puzzles")


@query("speed_label", """
SELECT run_id, puzzle_id, engine,
       CASE WHEN nps >= 1e6 THEN printf('%.1fM', nps / 1e6) WHEN nps >= 1e3 THEN printf('%.0fk', nps / 1e3)
            ELSE printf('%.0f', nps) END AS speed
FROM fx_answers""")
def q_speed_label(spark, d):
    a = fx.fx_answers(spark, d)
    return a.select("run_id", "puzzle_id", "engine", C.speed_label("nps").alias("speed"))


@query("live_view", """
WITH r AS (
  SELECT event_type AS engine, event_id, row_number() OVER w AS processed, value * 1000 AS nps,
         ROUND(SUM(CASE WHEN value >= 100 THEN 1 ELSE 0 END) OVER w * 100.0 / row_number() OVER w, 2) AS pct
  FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT engine, event_id, processed,
       CASE WHEN pct >= 98.0 THEN 'high' WHEN pct >= 90.0 THEN 'medium' ELSE 'low' END AS band,
       CASE WHEN nps >= 1e6 THEN printf('%.1fM', nps / 1e6) WHEN nps >= 1e3 THEN printf('%.0fk', nps / 1e3)
            ELSE printf('%.0f', nps) END AS speed,
       printf('%.1f', pct) AS accuracy_text
FROM r""")
def q_live_view(spark, d):
    ev = fx.table(spark, d, "events").select(
        F.col("event_type").alias("engine"), "ts", "event_id", (F.col("value") >= 100).alias("is_correct"),
        (F.col("value") * 1000).alias("nps"))
    r = T.running_accuracy(ev, by=("engine",), order=("ts", "event_id"))
    return T.live_view(r).select("engine", "event_id", "processed", "band", "speed", "accuracy_text")


@query("summary_report", """
WITH r AS (
  SELECT engine, COUNT(*) AS total_puzzles, CAST(SUM(CASE WHEN is_correct THEN 1 ELSE 0 END) AS BIGINT) AS solved,
         ROUND(AVG(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) * 100.0, 2) AS accuracy_pct,
         ROUND(AVG(nps), 0) AS avg_nps, ROUND(AVG(depth), 1) AS avg_depth,
         ROUND(AVG(elapsed_seconds), 3) AS avg_sec, ROUND(SUM(elapsed_seconds), 1) AS total_sec
  FROM fx_evals GROUP BY engine)
SELECT engine, format('{:,} / {:,}', solved, total_puzzles) AS solved_of_total,
       printf('%.2f%%', accuracy_pct) AS accuracy,
       CASE WHEN accuracy_pct >= 99.0 THEN 'high' ELSE 'medium' END AS band,
       format('{:,}', CAST(avg_nps AS BIGINT)) AS avg_nps_text, printf('%.1f', avg_depth) AS avg_depth_text,
       printf('%.3fs', avg_sec) AS avg_time, printf('%.1fs', total_sec) AS total_time,
       CASE WHEN contains(lower(engine), 'lc0') OR contains(lower(engine), 'leela') THEN 'lc0'
            WHEN contains(lower(engine), 'stockfish') THEN 'stockfish'
            WHEN contains(lower(engine), 'reckless') THEN 'reckless'
            WHEN contains(lower(engine), 'pawnocchio') THEN 'pawnocchio' ELSE 'other' END AS family
FROM r""")
def q_summary_report(spark, d):
    return T.summary_report(R.telemetry_rollup(fx.fx_evals(spark, d)))


@query("metrics_long", """
WITH r AS (
  SELECT event_type AS engine, row_number() OVER w AS step,
         ROUND(SUM(CASE WHEN value >= 100 THEN 1 ELSE 0 END) OVER w * 100.0 / row_number() OVER w, 2) AS running_accuracy_pct,
         CAST(user_id % 40 AS DOUBLE) AS depth, value * 1000 AS nps, value / 100.0 AS elapsed_seconds,
         CAST(event_id % 2300 + 800 AS DOUBLE) AS puzzle_rating,
         CASE WHEN value >= 100 THEN 1.0 ELSE 0.0 END::DOUBLE AS solved_binary
  FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT engine, step, engine || '/' || metric AS metric, CAST(value AS DOUBLE) AS value FROM r
UNPIVOT (value FOR metric IN (running_accuracy_pct, depth, nps, elapsed_seconds, puzzle_rating, solved_binary))""")
def q_metrics_long(spark, d):
    ev = fx.table(spark, d, "events").select(
        F.col("event_type").alias("engine"), "ts", "event_id", (F.col("value") >= 100).alias("is_correct"),
        (F.col("user_id") % 40).alias("depth"), (F.col("value") * 1000).alias("nps"),
        (F.col("value") / 100.0).alias("elapsed_seconds"), (F.col("event_id") % 2300 + 800).alias("rating"))
    return T.metrics_long(ev, order=("ts", "event_id"))


EXPECTED = schemas.EXPECTED_TABLES


# The 3NF tables a load made present (non-empty adapters) against the twelve expected
PRESENT = [("players", "fx_players"), ("openings", "fx_openings"), ("engines", "fx_engines"),
           ("benchmark_runs", "fx_runs"), ("puzzles", "fx_puzzles"), ("puzzle_evaluations", "fx_evals"),
           ("games", "fx_games"), ("game_moves", "fx_moves")]


@query("missing_tables", "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in schemas.EXPECTED_TABLES)
       + ") AS e(table_name) EXCEPT ALL (" + " UNION ALL ".join(
           f"SELECT '{t}' AS table_name WHERE EXISTS (SELECT 1 FROM {s})" for t, s in PRESENT) + ")")
def q_missing_tables(spark, d):
    from ..operators.scoring import missing_tables
    srcs = {"fx_players": fx.fx_players(spark, d), "fx_openings": fx.fx_openings(spark, d),
            "fx_engines": fx.fx_engines(spark), "fx_runs": fx.fx_runs(spark), "fx_puzzles": fx.fx_puzzles(spark, d),
            "fx_evals": fx.fx_evals(spark, d), "fx_games": fx.fx_games(spark, d), "fx_moves": fx.fx_moves(spark, d)}
    present = [t for t, s in PRESENT if srcs[s].limit(1).count() > 0]     # loaded = has rows
    return missing_tables(spark, schemas.EXPECTED_TABLES, present=present)
