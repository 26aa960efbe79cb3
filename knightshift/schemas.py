"""The relational model: Spark schemas of the twelve tables and their constraints.

Spark keeps no primary or foreign keys on file tables, so every constraint is
data here and checked by the jobs in ``operators.quality``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS, DT = T.TimestampType(), T.DateType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# --- fixed values: the data model (tables, keys, references, NOT NULL, lengths) -------
TABLES: dict[str, T.StructType] = {
    "players": _st(("player_id", S, False), ("display_name", S, False), ("title", S, True),
                   ("country", S, True)),
    "openings": _st(("eco", S, False), ("opening_name", S, False), ("variation_name", S, True)),
    "engines": _st(("engine_id", S, False), ("engine_name", S, False), ("version", S, False),
                   ("eval_paradigm", S, False), ("hardware_target", S, False)),
    "themes": _st(("theme_id", S, False), ("description", S, True)),
    "benchmark_runs": _st(("run_id", S, False), ("movetime_ms", I, False), ("total_puzzles", I, False),
                          ("wandb_run_id", S, True), ("started_at", TS, False), ("completed_at", TS, True)),
    "puzzles": _st(("puzzle_id", S, False), ("fen", S, False), ("solution_uci", S, False),
                   ("rating", I, False), ("rating_deviation", I, True), ("popularity", I, True),
                   ("nb_plays", I, True), ("game_url", S, True), ("daily_date", DT, True)),
    "puzzle_themes": _st(("puzzle_id", S, False), ("theme_id", S, False)),
    "puzzle_evaluations": _st(("run_id", S, False), ("puzzle_id", S, False), ("engine_id", S, False),
                              ("engine_move", S, False), ("engine_move_san", S, True),
                              ("solution_san", S, True), ("is_correct", B, False), ("depth", I, False),
                              ("nps", D, False), ("elapsed_seconds", D, False), ("evaluated_at", TS, False)),
    "games": _st(("game_id", S, False), ("event", S, True), ("site_url", S, True), ("game_date", DT, True),
                 ("white_player_id", S, False), ("black_player_id", S, False), ("white_elo", I, True),
                 ("black_elo", I, True), ("result", S, False), ("time_control", S, True), ("eco", S, True),
                 ("total_plies", I, False), ("termination", S, True), ("created_at", TS, True)),
    "game_moves": _st(("game_id", S, False), ("ply", I, False), ("move_number", I, False), ("turn", S, False),
                      ("fen", S, False), ("move_uci", S, False), ("move_san", S, False), ("eval_cp", I, True),
                      ("eval_mate", I, True), ("best_engine_move", S, True), ("centipawn_loss", I, True),
                      ("judgment", S, True), ("clock_seconds", D, True)),
    "engine_matches": _st(("match_id", S, False), ("engine1_id", S, False), ("engine2_id", S, False),
                          ("time_control", S, False), ("total_rounds", I, False), ("concurrency", I, True),
                          ("engine1_score", D, True), ("engine2_score", D, True), ("draws", I, True),
                          ("pgn_path", S, True), ("started_at", TS, False), ("completed_at", TS, True)),
    "engine_match_games": _st(("game_id", S, False), ("match_id", S, False), ("round_number", I, False),
                              ("white_engine_id", S, False), ("black_engine_id", S, False), ("result", S, False),
                              ("total_plies", I, False), ("white_avg_depth", D, True),
                              ("black_avg_depth", D, True), ("white_avg_movetime_sec", D, True),
                              ("black_avg_movetime_sec", D, True), ("termination", S, True),
                              ("moves_pgn", S, True), ("played_at", TS, True)),
}

PRIMARY_KEYS = {
    "players": ["player_id"], "openings": ["eco"], "engines": ["engine_id"], "themes": ["theme_id"],
    "benchmark_runs": ["run_id"], "puzzles": ["puzzle_id"], "puzzle_themes": ["puzzle_id", "theme_id"],
    "puzzle_evaluations": ["run_id", "puzzle_id", "engine_id"], "games": ["game_id"],
    "game_moves": ["game_id", "ply"], "engine_matches": ["match_id"], "engine_match_games": ["game_id"],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("puzzle_themes", "puzzle_id", "puzzles", "puzzle_id"),
    ("puzzle_themes", "theme_id", "themes", "theme_id"),
    ("puzzle_evaluations", "run_id", "benchmark_runs", "run_id"),
    ("puzzle_evaluations", "puzzle_id", "puzzles", "puzzle_id"),
    ("puzzle_evaluations", "engine_id", "engines", "engine_id"),
    ("games", "white_player_id", "players", "player_id"),
    ("games", "black_player_id", "players", "player_id"),
    ("games", "eco", "openings", "eco"),
    ("game_moves", "game_id", "games", "game_id"),
    ("engine_matches", "engine1_id", "engines", "engine_id"),
    ("engine_matches", "engine2_id", "engines", "engine_id"),
    ("engine_match_games", "match_id", "engine_matches", "match_id"),
    ("engine_match_games", "white_engine_id", "engines", "engine_id"),
    ("engine_match_games", "black_engine_id", "engines", "engine_id"),
]

# VARCHAR(n) limits
LENGTHS = {
    "players": {"title": 10, "country": 3}, "openings": {"eco": 3},
    "puzzles": {"solution_uci": 5},
    "puzzle_evaluations": {"engine_move": 5, "engine_move_san": 10, "solution_san": 10},
    "games": {"result": 7, "eco": 3},
    "game_moves": {"turn": 1, "move_uci": 5, "move_san": 10, "best_engine_move": 5, "judgment": 15},
    "engine_match_games": {"result": 7},
}

# lookups that the stored tables serve: (name, table, columns)
INDEXES = [
    ("idx_puzzle_eval_correct", "puzzle_evaluations", ["is_correct"]),
    ("idx_puzzle_eval_run", "puzzle_evaluations", ["run_id"]),
    ("idx_puzzle_rating", "puzzles", ["rating"]),
    ("idx_games_players", "games", ["white_player_id", "black_player_id"]),
    ("idx_games_eco", "games", ["eco"]),
    ("idx_moves_judgment", "game_moves", ["judgment"]),
    ("idx_moves_fen", "game_moves", ["fen"]),
    ("idx_matches_engines", "engine_matches", ["engine1_id", "engine2_id"]),
    ("idx_match_games_match", "engine_match_games", ["match_id"]),
]

# column defaults applied when a column is absent from an input
DEFAULTS = {
    "puzzles": {"popularity": 100, "nb_plays": 0},
    "engine_matches": {"concurrency": 1, "engine1_score": 0.0, "engine2_score": 0.0, "draws": 0},
}
# ---------------------------------------------------------------------------------------

EXPECTED_TABLES = list(TABLES)


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in TABLES[table].fields if not f.nullable]
