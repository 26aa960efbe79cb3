"""Registered queries: match text -> games, moves, scores, standings (S8-S10, P11-P16,
W4, W5, A8-A11, K3, K5, K6, K9).  The Spark side builds the text, writes it,
reads it back and parses it; the oracles use the adapter columns directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import matches as M
from ..session import landed, scratch_path
from ..sinks import files as K
from ..sources import pgn as SRC
from . import fixtures as fx
from .joins import bounded_broadcast
from .pgn_fixture import NOTE, pgn_files
from .registry import query

E1, E2, TC, ROUNDS = "Lc0", "Reckless", "10+0.1", 12
LOAD_TS = "2026-01-01T00:00:00+00:00"

# a move's whole comment: the adapter's, then the fixture's note
COMMENT = (f"CASE WHEN m.ply % 4 = 3 AND m.game_id % 2 = 0 THEN CASE WHEN m.comment = '' THEN '{NOTE}' ELSE m.comment || ' {NOTE}' END "
           "ELSE m.comment END")
G = """g AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY game_id) AS game_no,
              termination = 'Time forfeit' AS bs FROM fx_games)"""
MV = f"""mv AS (
  SELECT g.match_id, g.game_no, CAST(m.ply AS INTEGER) AS ply,
         CAST(CASE WHEN g.bs THEN 1 + floor(m.ply / 2) ELSE 1 + floor((m.ply - 1) / 2) END AS INTEGER) AS move_number,
         CASE WHEN g.bs THEN (CASE WHEN m.ply % 2 = 1 THEN 'b' ELSE 'w' END) ELSE m.turn END AS turn,
         m.move_san, {COMMENT} AS comment,
         TRY_CAST(replace(NULLIF(regexp_extract(m.comment, '([+-]?\\d+\\.?\\d*|\\#?[+-]?\\d+)/(\\d+)', 1), ''), '#', '') AS DOUBLE) AS eval,
         TRY_CAST(NULLIF(regexp_extract(m.comment, '([+-]?\\d+\\.?\\d*|\\#?[+-]?\\d+)/(\\d+)', 2), '') AS INTEGER) AS depth,
         TRY_CAST(NULLIF(regexp_extract(m.comment, '(\\d+\\.?\\d*)s', 1), '') AS DOUBLE) AS seconds
  FROM fx_moves m JOIN g ON m.game_id = g.game_id)"""
SIDES = """sides AS (
  SELECT match_id, game_no,
    list_reduce(list(CAST(depth AS DOUBLE) ORDER BY ply) FILTER (WHERE turn = 'w' AND depth IS NOT NULL), lambda a, x: a + x)
      / count(depth) FILTER (WHERE turn = 'w') AS white_avg_depth,
    list_reduce(list(CAST(depth AS DOUBLE) ORDER BY ply) FILTER (WHERE turn = 'b' AND depth IS NOT NULL), lambda a, x: a + x)
      / count(depth) FILTER (WHERE turn = 'b') AS black_avg_depth,
    list_reduce(list(seconds ORDER BY ply) FILTER (WHERE turn = 'w' AND seconds IS NOT NULL), lambda a, x: a + x)
      / count(seconds) FILTER (WHERE turn = 'w') AS white_avg_movetime_sec,
    list_reduce(list(seconds ORDER BY ply) FILTER (WHERE turn = 'b' AND seconds IS NOT NULL), lambda a, x: a + x)
      / count(seconds) FILTER (WHERE turn = 'b') AS black_avg_movetime_sec
  FROM mv GROUP BY match_id, game_no)"""
IDS = """ids AS (SELECT *,
   CASE WHEN contains(lower(white), 'lc0') THEN 'lc0' WHEN contains(lower(white), 'reckless') THEN 'reckless' ELSE lower(white) END AS white_engine_id,
   CASE WHEN contains(lower(black), 'reckless') THEN 'reckless' WHEN contains(lower(black), 'lc0') THEN 'lc0' ELSE lower(black) END AS black_engine_id
   FROM g)"""


def _games(spark, d):
    """The games of the match files, cut once per application."""
    return spark.read.parquet(landed(spark, f"games:{d}", lambda path: SRC.read_games_text(spark, pgn_files(spark, d)).write.parquet(path)))


def _parsed(spark, d):
    return M.parse_games(_games(spark, d))


@query("src_games_text", f"""
WITH {G}, n AS (SELECT game_id, COUNT(*) AS c FROM fx_moves GROUP BY game_id)
SELECT g.match_id, g.game_no, g.white, g.black, g.result, CAST(COALESCE(n.c, 0) AS INTEGER) AS n_moves
FROM g LEFT JOIN n ON g.game_id = n.game_id""")
def q_src_games_text(spark, d):
    p = _parsed(spark, d)
    return p.select("match_id", "game_no", "white", "black", "result", F.col("plies").alias("n_moves"))


@query("number_games", f"""
WITH {G} SELECT match_id, game_no, game_id AS source_game FROM g""")
def q_number_games(spark, d):
    p = _parsed(spark, d)
    site = M.header("pgn", "Site")
    return p.select("match_id", "game_no", F.regexp_extract(site, r"(\d+)$", 1).cast("bigint").alias("source_game"))


@query("parse_headers", f"""
WITH {G}, n AS (SELECT game_id, COUNT(*) AS c FROM fx_moves GROUP BY game_id)
SELECT g.match_id, g.game_no, g.result, g.termination,
       CAST(COALESCE(n.c, 0) AS INTEGER) AS total_plies,
       CAST(CASE WHEN g.bs THEN g.game_no ELSE g.game_id END AS INTEGER) AS round_number,
       CASE WHEN g.bs THEN 'b' ELSE 'w' END AS first_turn
FROM g LEFT JOIN n ON g.game_id = n.game_id""")
def q_parse_headers(spark, d):
    gt = M.game_table(_parsed(spark, d), E1, E2, LOAD_TS)
    return gt.select(
        "match_id", "game_no", "result", "termination", "total_plies", "round_number", "first_turn")


@query("game_moves", f"""
WITH {G}, {MV}
SELECT match_id, game_no, ply, move_number, turn, move_san, comment, eval, depth, seconds FROM mv""")
def q_game_moves(spark, d):
    return M.explode_moves(_parsed(spark, d))


@query("game_side_stats", f"""
WITH {G}, {MV}, {SIDES}
SELECT g.match_id, g.game_no, s.white_avg_depth, s.black_avg_depth, s.white_avg_movetime_sec, s.black_avg_movetime_sec
FROM g LEFT JOIN sides s ON g.match_id = s.match_id AND g.game_no = s.game_no""")
def q_game_side_stats(spark, d):
    s = M.side_stats(_parsed(spark, d))
    return s.select("match_id", "game_no", "white_avg_depth", "black_avg_depth",
                    "white_avg_movetime_sec", "black_avg_movetime_sec")


@query("annotate_pgn", f"""
WITH {G}, {MV}, {SIDES}
SELECT g.match_id, g.game_no,
       printf('%.1f', COALESCE(s.white_avg_depth, 0.0)) AS WhiteAvgDepth,
       printf('%.1f', COALESCE(s.black_avg_depth, 0.0)) AS BlackAvgDepth,
       printf('%.3fs', COALESCE(s.white_avg_movetime_sec, 0.0)) AS WhiteAvgMoveTime,
       printf('%.3fs', COALESCE(s.black_avg_movetime_sec, 0.0)) AS BlackAvgMoveTime
FROM g LEFT JOIN sides s ON g.match_id = s.match_id AND g.game_no = s.game_no""")
def q_annotate_pgn(spark, d):
    a = M.annotate(M.parse_games(K.in_match_order(_games(spark, d))))
    # the annotated games are written in game order (range partitioned, sorted) and read
    # back; their numbers come from file order again, so no join is needed
    path = scratch_path(spark, "annotated")
    (a.select(F.col("annotated_pgn").alias("value"), "match_id")
     .write.mode("overwrite").partitionBy("match_id").option("lineSep", "\n\n").text(path))
    back = SRC.read_games_text(spark, path)
    tags = ["WhiteAvgDepth", "BlackAvgDepth", "WhiteAvgMoveTime", "BlackAvgMoveTime"]
    return M.with_headers(back, "pgn", {t: t for t in tags}).select("match_id", "game_no", *tags)


@query("match_scores", f"""
WITH {G}, {IDS}
SELECT match_id, 'lc0' AS engine1_id, 'reckless' AS engine2_id, '{TC}' AS time_control,
       CAST({ROUNDS} AS INTEGER) AS total_rounds, 1 AS concurrency,
       SUM(CASE WHEN result = '1-0' AND white_engine_id = 'lc0' THEN 1.0::DOUBLE
                WHEN result = '0-1' AND black_engine_id = 'lc0' THEN 1.0::DOUBLE
                WHEN result = '1/2-1/2' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS engine1_score,
       SUM(CASE WHEN result = '1-0' AND white_engine_id <> 'lc0' THEN 1.0::DOUBLE
                WHEN result = '0-1' AND black_engine_id <> 'lc0' THEN 1.0::DOUBLE
                WHEN result = '1/2-1/2' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS engine2_score,
       CAST(SUM(CASE WHEN result = '1/2-1/2' THEN 1 ELSE 0 END) AS INTEGER) AS draws,
       'db://engine_match_games_' || match_id || '.parquet' AS pgn_path,
       COALESCE(arg_min(strftime(played_at, '%Y-%m-%dT00:00:00'), game_no) FILTER (WHERE result <> '1/2-1/2'),
                '{LOAD_TS}') AS started_at,
       arg_max(strftime(played_at, '%Y-%m-%dT%H:%M:%S'), game_no) AS completed_at
FROM ids GROUP BY match_id""")
def q_match_scores(spark, d):
    matches, _, _ = M.ingest_games(_games(spark, d), E1, E2, TC, ROUNDS, LOAD_TS)
    return matches


@query("map_engines", f"""
WITH {G}, {IDS} SELECT game_id, white_engine_id, black_engine_id FROM ids""")
def q_map_engines(spark, d):
    g = fx.fx_games(spark, d)
    return g.select("game_id", C.map_engine("white", F.lit(E1), F.lit(E2)).alias("white_engine_id"),
                    C.map_engine("black", F.lit(E2), F.lit(E1)).alias("black_engine_id"))


@query("game_points", """
SELECT game_id, CASE result WHEN '1-0' THEN 1.0::DOUBLE WHEN '0-1' THEN 0.0::DOUBLE WHEN '1/2-1/2' THEN 0.5::DOUBLE END AS white_points,
       1.0::DOUBLE - CASE result WHEN '1-0' THEN 1.0::DOUBLE WHEN '0-1' THEN 0.0::DOUBLE WHEN '1/2-1/2' THEN 0.5::DOUBLE END AS black_points
FROM fx_games""")
def q_game_points(spark, d):
    g = fx.fx_games(spark, d)
    return g.select("game_id", C.white_points("result").alias("white_points"),
                    C.black_points("result").alias("black_points"))


@query("first_turn", """
SELECT puzzle_id, CASE WHEN split_part(fen_before, ' ', 2) = 'b' THEN 'b' ELSE 'w' END AS turn_before,
       CASE WHEN split_part(fen, ' ', 2) = 'b' THEN 'b' ELSE 'w' END AS turn_after
FROM fx_puzzles""")
def q_first_turn(spark, d):
    z = fx.fx_puzzles(spark, d)
    return z.select("puzzle_id", C.first_turn("fen_before").alias("turn_before"), C.first_turn("fen").alias("turn_after"))


@query("parse_comment", """
SELECT game_id, CAST(ply AS INTEGER) AS ply,
       TRY_CAST(replace(NULLIF(regexp_extract(comment, '([+-]?\\d+\\.?\\d*|\\#?[+-]?\\d+)/(\\d+)', 1), ''), '#', '') AS DOUBLE) AS eval,
       TRY_CAST(NULLIF(regexp_extract(comment, '([+-]?\\d+\\.?\\d*|\\#?[+-]?\\d+)/(\\d+)', 2), '') AS INTEGER) AS depth,
       TRY_CAST(NULLIF(regexp_extract(comment, '(\\d+\\.?\\d*)s', 1), '') AS DOUBLE) AS seconds
FROM fx_moves""")
def q_parse_comment(spark, d):
    m = fx.fx_moves(spark, d)
    t = C.parse_comment("comment")
    return m.select("game_id", F.col("ply").cast("int").alias("ply"), t["eval"].alias("eval"),
                    t["depth"].alias("depth"), t["seconds"].alias("seconds"))


WDL_SQL = """
wdl AS (SELECT engine, COUNT(*) AS games, COUNT(*) FILTER (WHERE o = 'W') AS wins,
               COUNT(*) FILTER (WHERE o = 'D') AS draws, COUNT(*) FILTER (WHERE o = 'L') AS losses
        FROM (SELECT lower(white) AS engine, CASE result WHEN '1-0' THEN 'W' WHEN '0-1' THEN 'L' WHEN '1/2-1/2' THEN 'D' END AS o FROM fx_games
              UNION ALL
              SELECT lower(black), CASE result WHEN '0-1' THEN 'W' WHEN '1-0' THEN 'L' WHEN '1/2-1/2' THEN 'D' END FROM fx_games) t
        GROUP BY engine)"""


@query("wdl", f"WITH {WDL_SQL} SELECT * FROM wdl")
def q_wdl(spark, d):
    return M.standings(fx.fx_games(spark, d))


@query("match_summary", f"""
WITH {WDL_SQL}
SELECT engine, printf('%s_SCORE: +%d =%d -%d (%dW-%dD-%dL)', engine, wins, draws, losses, wins, draws, losses) AS summary
FROM wdl""")
def q_match_summary(spark, d):
    return M.summary_line(M.standings(fx.fx_games(spark, d))).select("engine", "summary")


@query("color_balance", """
SELECT match_id, engine, CAST(SUM(w) AS BIGINT) AS white_games, CAST(SUM(b) AS BIGINT) AS black_games,
       SUM(w) = SUM(b) AS balanced
FROM (SELECT match_id, lower(white) AS engine, 1 AS w, 0 AS b FROM fx_games
      UNION ALL SELECT match_id, lower(black), 0, 1 FROM fx_games) t
GROUP BY match_id, engine""")
def q_color_balance(spark, d):
    return M.color_balance(fx.fx_games(spark, d))


@query("pair_games", """
SELECT least(lower(white), lower(black)) AS engine_a, greatest(lower(white), lower(black)) AS engine_b, COUNT(*) AS games
FROM fx_games GROUP BY 1, 2""")
def q_pair_games(spark, d):
    return M.pair_games(fx.fx_games(spark, d))


def _stored(spark, d) -> str:
    """The match database of ``d`` (parsed and stored once per application); returns its root."""
    return landed(spark, f"matchdb:{d}", lambda root: M.store_games(
        _games(spark, d), root, E1, E2, TC, ROUNDS, LOAD_TS))


@query("src_match_lookup", f"""
WITH {G}
SELECT match_id, game_no FROM g
WHERE match_id = (SELECT min(match_id) FROM fx_games WHERE contains(match_id, 'atch_4'))""")
def q_src_match_lookup(spark, d):
    games = spark.read.parquet(f"{_stored(spark, d)}/engine_match_games")
    return SRC.lookup_match(games, "atch_4").select("match_id", "game_no")


MATCHES = f"""scores AS (
  SELECT match_id,
       SUM(CASE WHEN result = '1-0' AND white_engine_id = 'lc0' THEN 1.0::DOUBLE
                WHEN result = '0-1' AND black_engine_id = 'lc0' THEN 1.0::DOUBLE
                WHEN result = '1/2-1/2' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS engine1_score,
       SUM(CASE WHEN result = '1-0' AND white_engine_id <> 'lc0' THEN 1.0::DOUBLE
                WHEN result = '0-1' AND black_engine_id <> 'lc0' THEN 1.0::DOUBLE
                WHEN result = '1/2-1/2' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS engine2_score,
       CAST(SUM(CASE WHEN result = '1/2-1/2' THEN 1 ELSE 0 END) AS INTEGER) AS draws,
       COALESCE(arg_min(strftime(played_at, '%Y-%m-%dT00:00:00'), game_no) FILTER (WHERE result <> '1/2-1/2'),
                '{LOAD_TS}') AS started_at,
       arg_max(strftime(played_at, '%Y-%m-%dT%H:%M:%S'), game_no) AS completed_at
  FROM ids GROUP BY match_id)"""
TELEMETRY = """
       printf('%.1f', s.white_avg_depth) AS white_depth_tag, printf('%.1f', s.black_avg_depth) AS black_depth_tag,
       printf('%.3fs', s.white_avg_movetime_sec) AS white_time_tag, printf('%.3fs', s.black_avg_movetime_sec) AS black_time_tag,
       'telemetry engine' AS annotator_tag"""


TELEMETRY_NAMES = {"white_depth_tag": "WhiteAvgDepth", "black_depth_tag": "BlackAvgDepth", "white_time_tag": "WhiteAvgMoveTime",
                   "black_time_tag": "BlackAvgMoveTime", "annotator_tag": "Annotator"}


@query("write_matches", f"""
WITH {G}, {MV}, {SIDES}, {IDS}, {MATCHES}, n AS (SELECT game_id, COUNT(*) AS c FROM fx_moves GROUP BY game_id)
SELECT i.match_id || '_g' || i.game_no AS game_id, i.match_id, i.game_no,
       CAST(CASE WHEN i.bs THEN i.game_no ELSE i.game_id END AS INTEGER) AS round_number,
       i.white_engine_id, i.black_engine_id, i.result, CAST(COALESCE(n.c, 0) AS INTEGER) AS total_plies,
       s.white_avg_depth, s.black_avg_depth, s.white_avg_movetime_sec, s.black_avg_movetime_sec,
       i.termination, strftime(i.played_at, '%Y-%m-%dT%H:%M:%S') AS played_at, {TELEMETRY},
       'lc0' AS engine1_id, 'reckless' AS engine2_id, '{TC}' AS time_control, CAST({ROUNDS} AS INTEGER) AS total_rounds,
       1 AS concurrency, m.engine1_score, m.engine2_score, m.draws,
       'db://engine_match_games_' || i.match_id || '.parquet' AS pgn_path, m.started_at, m.completed_at
FROM ids i JOIN scores m ON m.match_id = i.match_id LEFT JOIN n ON i.game_id = n.game_id
LEFT JOIN sides s ON i.match_id = s.match_id AND i.game_no = s.game_no""")
def q_write_matches(spark, d):
    root = _stored(spark, d)
    games, matches = spark.read.parquet(f"{root}/engine_match_games"), spark.read.parquet(f"{root}/engine_matches")
    own = M.with_headers(games, "moves_pgn", TELEMETRY_NAMES).select(
        "game_id", "match_id", "game_no", "round_number", "white_engine_id", "black_engine_id", "result",
        "total_plies", "white_avg_depth", "black_avg_depth", "white_avg_movetime_sec", "black_avg_movetime_sec",
        "termination", "played_at", *TELEMETRY_NAMES)
    return own.join(bounded_broadcast(matches), "match_id")     # games of few matches would meet in few tasks


@query("match_game_ids", """SELECT 'engine_match_games' AS table_name, 0::BIGINT AS duplicate_keys, 0::BIGINT AS null_keys,
  count(*)::BIGINT AS games FROM orders""")
def q_match_game_ids(spark, d):
    """C1 over the stored games: ``game_id`` is a key, and no game of the text is lost."""
    games = spark.read.parquet(f"{_stored(spark, d)}/engine_match_games")
    per_id = games.groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(F.lit("engine_match_games").alias("table_name"),
                      F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.count_if(F.col("game_id").isNull()).alias("null_keys"),
                      F.sum("n").alias("games"))


@query("export_pgn", f"""
WITH {G}, {MV}, {SIDES}
SELECT g.game_no, g.white, g.black, g.result, {TELEMETRY} FROM g
LEFT JOIN sides s ON g.match_id = s.match_id AND g.game_no = s.game_no WHERE g.match_id = 'match_7'""")
def q_export_pgn(spark, d):
    games = spark.read.parquet(f"{_stored(spark, d)}/engine_match_games")
    path = K.export_pgn(SRC.lookup_match(games, "match_7"), scratch_path(spark, "export"))
    back = SRC.read_games_text(spark, path, match_from_path=False)
    names = {"white": "White", "black": "Black", "result": "Result", **TELEMETRY_NAMES}
    return M.with_headers(back, "pgn", names).select("game_no", *names)
