"""The twelve tables of the data model with planted violations, as SQL over the driver's tables.

One text per table, run by Spark (``model_tables``) and inlined in the oracles
(``with_model``).  Every key, reference, NOT NULL column and length limit of
``schemas`` that a table of its size can break is broken by some rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from . import fixtures as fx

BASE = ["region", "nation", "customer", "part", "orders", "lineitem"]


def _every(n: int, key: str, otherwise: str, planted: str = "NULL") -> str:
    return f"CASE WHEN {key} % {n} = 0 THEN {planted} ELSE {otherwise} END"


def _text(expr: str, prefix: str = "") -> str:
    return f"concat('{prefix}', CAST({expr} AS VARCHAR(20)))"


MODEL = {
    "players": f"""SELECT {_every(97, 'c_custkey', _text('c_custkey - CASE WHEN c_custkey % 101 = 0 THEN 1 ELSE 0 END', 'u'))} AS player_id,
  {_every(89, 'c_custkey', 'c_name')} AS display_name, {_every(83, 'c_custkey', "'GM'", "'Grandmaster'")} AS title,
  {_every(79, 'c_custkey', "'USA'", "'USSR'")} AS country FROM customer""",
    "openings": f"""SELECT {_every(11, '(n_nationkey + 1)', _text('n_nationkey % 20 + 10', 'A'), "'A100'")} AS eco,
  {_every(7, '(n_nationkey + 1)', 'n_name')} AS opening_name, CAST(NULL AS VARCHAR(10)) AS variation_name FROM nation""",
    "engines": f"""SELECT {_every(5, '(r_regionkey + 1)', _text('r_regionkey', 'e'))} AS engine_id, {_every(4, '(r_regionkey + 1)', 'r_name')} AS engine_name,
  {_every(3, '(r_regionkey + 1)', "'1'")} AS version, 'NNUE' AS eval_paradigm, {_every(2, '(r_regionkey + 1)', "'CPU'")} AS hardware_target FROM region""",
    "themes": f"""SELECT {_every(5, '(n_nationkey + 1)', _text('n_nationkey % 12', 't'))} AS theme_id, n_name AS description FROM nation""",
    "benchmark_runs": f"""SELECT {_text('n_nationkey % 20', 'run_')} AS run_id, {_every(6, '(n_nationkey + 1)', '500')} AS movetime_ms,
  {_every(8, '(n_nationkey + 1)', '100')} AS total_puzzles, CAST(NULL AS VARCHAR(10)) AS wandb_run_id,
  {_every(9, '(n_nationkey + 1)', "'2026-01-01'")} AS started_at, CAST(NULL AS VARCHAR(10)) AS completed_at FROM nation""",
    "puzzles": f"""SELECT {_text('p_partkey - CASE WHEN p_partkey % 50 = 49 THEN 1 ELSE 0 END', 'p')} AS puzzle_id, {_every(61, 'p_partkey', 'p_name')} AS fen,
  {_every(53, 'p_partkey', "'e2e4'", "'e7e8qq'")} AS solution_uci, {_every(67, 'p_partkey', '1500 + p_partkey % 900')} AS rating FROM part""",
    "puzzle_themes": f"""SELECT {_every(41, 'p_partkey', _text('p_partkey', 'p'), "'x'")} AS puzzle_id, {_every(43, 'p_partkey', _text('p_partkey % 14', 't'))} AS theme_id FROM part""",
    "puzzle_evaluations": f"""SELECT {_text('l_suppkey % 21', 'run_')} AS run_id, {_text('l_partkey', 'p')} AS puzzle_id, {_text('l_linenumber % 6', 'e')} AS engine_id,
  {_every(101, 'l_orderkey', _every(103, 'l_orderkey', "'e2e4'", "'e2e4e5'"))} AS engine_move, {_every(107, 'l_orderkey', "'Nf3'", "'Nf3xxxxxxxxx'")} AS engine_move_san,
  {_every(109, 'l_orderkey', "'Nf3'", "'Nf3yyyyyyyyyyy'")} AS solution_san, {_every(113, 'l_orderkey', 'l_orderkey % 2 = 0')} AS is_correct,
  {_every(127, 'l_orderkey', '12')} AS depth, {_every(131, 'l_orderkey', '1000.0')} AS nps, {_every(137, 'l_orderkey', '0.5')} AS elapsed_seconds,
  {_every(139, 'l_orderkey', "'2026-01-01'")} AS evaluated_at FROM lineitem""",
    "games": f"""SELECT {_text('o_orderkey - CASE WHEN o_orderkey % 64 = 63 THEN 1 ELSE 0 END', 'g')} AS game_id, {_every(71, 'o_orderkey', _text('o_custkey', 'u'), "'u?'")} AS white_player_id,
  {_text('o_custkey * 7 % 1500 + 1', 'u')} AS black_player_id, {_every(73, 'o_orderkey', "'1-0'", "'unfinished'")} AS result,
  {_text('o_custkey % 27 + CASE WHEN o_orderkey % 87 = 0 THEN 100 ELSE 10 END', 'A')} AS eco, {_every(77, 'o_orderkey', '40')} AS total_plies FROM orders""",
    "game_moves": f"""SELECT {_text('l_orderkey', 'g')} AS game_id, {_every(59, 'l_orderkey', 'l_linenumber')} AS ply, l_linenumber AS move_number,
  {_every(57, 'l_orderkey', "'w'", "'ww'")} AS turn, {_every(149, 'l_orderkey', "'8/8'")} AS fen, {_every(151, 'l_orderkey', "'e2e4'", "'e2e4e5'")} AS move_uci,
  {_every(157, 'l_orderkey', "'e4'", "'e4!!!!!!!!!!'")} AS move_san, {_every(163, 'l_orderkey', "'e2e4'", "'e2e4e5'")} AS best_engine_move,
  {_every(167, 'l_orderkey', "'best'", "'an inexplicable move'")} AS judgment FROM lineitem""",
    "engine_matches": f"""SELECT {_text('c_custkey % 400', 'm')} AS match_id, {_text('c_custkey % 7', 'e')} AS engine1_id, {_text('c_custkey % 6', 'e')} AS engine2_id,
  {_every(47, 'c_custkey', "'1+0'")} AS time_control, {_every(37, 'c_custkey', '10')} AS total_rounds, {_every(29, 'c_custkey', "'2026-01-01'")} AS started_at FROM customer""",
    "engine_match_games": f"""SELECT {_text('o_orderkey - CASE WHEN o_orderkey % 128 = 127 THEN 1 ELSE 0 END', 'g')} AS game_id, {_text('o_custkey % 450', 'm')} AS match_id, {_every(31, 'o_orderkey', '1')} AS round_number,
  {_text('o_orderkey % 5', 'e')} AS white_engine_id, {_every(23, 'o_orderkey', _text('o_orderkey % 6', 'e'))} AS black_engine_id,
  {_every(19, 'o_orderkey', "'0-1'", "'adjourned'")} AS result, {_every(17, 'o_orderkey', '60')} AS total_plies FROM orders""",
}


def model_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The twelve tables as DataFrames."""
    base = {t: fx.table(spark, d, t) for t in BASE}
    out = {}
    for name, sql in MODEL.items():
        source = sql.rsplit(" ", 1)[1]
        out[name] = spark.sql(f"{sql[:-len(source)]}{{{source}}}", **{source: base[source]})
    return out


def with_model(sql: str) -> str:
    """``sql`` behind the twelve tables as common table expressions."""
    return "WITH " + ",\n".join(f"{t} AS ({body})" for t, body in MODEL.items()) + "\n" + sql


def checks_sql() -> str:
    """DuckDB SQL of every check of ``schemas``, constraint by constraint."""
    parts = []
    for t, keys in schemas.PRIMARY_KEYS.items():
        nul = " OR ".join(f"{k} IS NULL" for k in keys)
        parts.append(f"SELECT 'primary_key' AS constraint_type, '{t}' AS table_name, '{','.join(keys)}' AS column_names, count(*) FILTER (WHERE n > 1) AS violations,"
                     f" CAST(coalesce(sum(n) FILTER (WHERE nul), 0) AS BIGINT) AS detail FROM (SELECT count(*) AS n, bool_or({nul}) AS nul FROM {t} GROUP BY {', '.join(keys)})")
    for child, c, parent, p in schemas.FOREIGN_KEYS:
        parts.append(f"SELECT 'foreign_key', '{child}', '{c}->{parent}.{p}', count(*), count(DISTINCT {c}) FROM {child}"
                     f" WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} q WHERE q.{p} = {child}.{c})")
    for t in MODEL:
        for c in schemas.not_null_columns(t):
            parts.append(f"SELECT 'not_null', '{t}', '{c}', count(*) FILTER (WHERE {c} IS NULL), count(*) FROM {t}")
    for t, limits in schemas.LENGTHS.items():
        for c, n in limits.items():
            parts.append(f"SELECT 'length', '{t}', '{c}', count(*) FILTER (WHERE length({c}) > {n}), CAST(coalesce(max(length({c})), 0) AS BIGINT) FROM {t}")
    return with_model("\nUNION ALL\n".join(parts))
