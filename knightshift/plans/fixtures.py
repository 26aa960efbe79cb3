"""Adapters: shape the driver's TPC-H-like tables into the chess benchmark tables.

Every adapter exists twice: as a DataFrame builder (what ``queries()`` runs on)
and as a SQL body (inlined as a CTE in ``oracle_sql()``).  Both follow
FIXTURES.md section 2 exactly.  The DataFrame forms avoid joins against the
tiny literal tables: a literal array is indexed (``element_at``) or exploded,
which is a per-row projection / generate, not a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- fixed values (FIXTURES.md §2) -------------------------------------------
# k, fen_before, first_move, fen_after, solution, solution_san
POSITIONS = [
    (0, "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "e2e4",
     "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1", "e7e5", "e5"),
    (1, "r1bqk2r/pppp1ppp/2n5/1B2p3/4n3/5N2/PPPP1PPP/RNBQK2R w KQkq - 0 5", "e1g1",
     "r1bqk2r/pppp1ppp/2n5/1B2p3/4n3/5N2/PPPP1PPP/RNBQ1RK1 b kq - 1 5", "e4d6", "Nd6"),
    (2, "8/P6k/8/8/8/8/7K/8 w - - 0 1", "a7a8q", "Q7/7k/8/8/8/8/7K/8 b - - 0 1", "h7g6", "Kg6"),
    (3, "4k3/8/8/8/5p2/8/4P3/4K3 w - - 0 1", "e2e4", "4k3/8/8/8/4Pp2/8/8/4K3 b - e3 0 1", "f4e3", "fxe3"),
    (4, "8/8/8/8/R4p1k/8/4P3/4K3 w - - 0 1", "e2e4", "8/8/8/8/R3Pp1k/8/8/4K3 b - - 0 1", "f4f3", "f3"),
    (5, "6k1/p4ppp/8/8/8/8/5PPP/1R4K1 b - - 0 1", "a7a6", "6k1/5ppp/p7/8/8/8/5PPP/1R4K1 w - - 0 2", "b1b8", "Rb8#"),
    (6, "4k3/8/8/8/8/8/4K3/R6R b - - 0 1", "e8e7", "8/4k3/8/8/8/8/4K3/R6R w - - 1 2", "a1d1", "Rad1"),
    (7, "r3k3/8/8/8/8/8/8/R3K3 b Qq - 0 1", "a8a1", "4k3/8/8/8/8/8/8/r3K3 w - - 0 2", "e1d2", "Kd2"),
]
# eidx, engine_id, engine_name, version, eval_paradigm, hardware_target
ENGINES = [
    (0, "stockfish_18", "Stockfish 18", "18", "Alpha_Beta_NNUE", "CPU_AVX512"),
    (1, "pawnocchio_2_0_1", "Pawnocchio 2.0.1", "2.0.1", "Alpha_Beta_NNUE", "CPU_AVX512"),
    (2, "reckless_0_9_0", "Reckless 0.9.0", "0.9.0", "Alpha_Beta_NNUE", "CPU_AVX512"),
    (3, "lc0_v0_32_1", "Lc0 v0.32.1", "0.32.1", "Neural_MCTS", "GPU_TensorCore"),
]
# ridx, run_id, movetime_ms
RUNS = [(0, "run_a", 500), (1, "run_b", 2000)]
# ------------------------------------------------------------------------------

POSITION_COLS = ["k", "fen_before", "first_move", "fen_after", "solution", "solution_san"]
ENGINE_COLS = ["eidx", "engine_id", "engine_name", "version", "eval_paradigm", "hardware_target"]
RUN_COLS = ["ridx", "run_id", "movetime_ms"]

PARTS_PER_TASK = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal_rows(rows, cols) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(r, cols)]) for r in rows])


def fx_positions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POSITIONS, "k int, fen_before string, first_move string, "
                                 "fen_after string, solution string, solution_san string")


def fx_engines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENGINES, "eidx int, engine_id string, engine_name string, "
                                 "version string, eval_paradigm string, hardware_target string")


def fx_runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, "ridx int, run_id string, movetime_ms int")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and names of the parts, ``PARTS_PER_TASK`` a task: a small file of them is one split, whose every row
    becomes a puzzle of many columns and eight answers."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    tasks = -(-parts.count() // PARTS_PER_TASK)          # read from the footers
    return parts.repartition(tasks, "p_partkey", "p_name") if tasks > 1 else parts


def fx_puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One puzzle per part; the position is picked by ``p_partkey % 8``."""
    pos = F.element_at(_literal_rows(POSITIONS, POSITION_COLS), (F.col("p_partkey") % 8 + 1).cast("int"))
    return (_parts(spark, sf_dir)
            .select("p_partkey", "p_name", pos.alias("f"))
            .select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("puzzle_id"),
                    F.col("p_partkey").alias("pos"),
                    F.col("f.fen_before"),
                    F.concat_ws(" ", "f.first_move", "f.solution").alias("moves"),
                    F.col("f.fen_after").alias("fen"),
                    F.col("f.solution"), F.col("f.solution_san"),
                    (F.lit(800) + (F.col("p_partkey") * 37) % 2300).cast("int").alias("rating"),
                    ((F.col("p_partkey") * 13) % 201 - 100).cast("int").alias("popularity"),
                    F.col("p_name").alias("themes"),
                    F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")).alias("game_url")))


def _answer_columns() -> list[Column]:
    """fx_answers columns over the expanded rows (struct columns ``e`` engine, ``r`` run)."""
    code = F.col("pos") * 3 + F.col("e.eidx") * 5 + F.col("r.ridx") * 7
    return [
        F.col("r.run_id").alias("run_id"), F.col("puzzle_id"), F.col("pos"),
        F.col("e.engine_name").alias("engine"), F.col("e.engine_id").alias("engine_id"),
        F.when(code % 22 == 0, F.lit("0000")).when(code % 11 == 0, F.lit("a1b1"))
         .otherwise(F.col("solution")).alias("engine_move"),
        (F.lit(5) + (F.col("pos") * 7 + F.col("e.eidx") * 13) % 60).cast("int").alias("depth"),
        (F.lit(50000) * (F.col("e.eidx") + 1) + (F.col("pos") * 101) % 9973).cast("double").alias("nps"),
        (((F.col("pos") * 31 + F.col("e.eidx") * 17) % 487).cast("double") / F.lit(1000.0)).alias("elapsed_seconds"),
    ]


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puzzles expanded to puzzle x engine x run by a generator (8 rows each), not a join."""
    combos = [(e, r) for r in RUNS for e in ENGINES]
    arr = F.array(*[F.struct(F.struct(*[F.lit(v).alias(c) for v, c in zip(e, ENGINE_COLS)]).alias("e"),
                             F.struct(*[F.lit(v).alias(c) for v, c in zip(r, RUN_COLS)]).alias("r"))
                    for e, r in combos])
    return fx_puzzles(spark, sf_dir).select("*", F.inline(arr))


def fx_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir).select(*_answer_columns())


def fx_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored evaluations.  ``puzzle_id`` is unique in fx_puzzles, so the answer
    rows already carry their puzzle's columns: no join is needed to build it."""
    a = _expanded(spark, sf_dir).select(*_answer_columns(), "fen", "solution", "rating")
    return a.select("run_id", "puzzle_id", "pos", "fen", "solution", "engine_move",
                    (F.col("engine_move") == F.col("solution")).alias("is_correct"),
                    "depth", "nps", "elapsed_seconds", "rating", "engine", "engine_id")


def fx_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    return o.select(
        F.col("o_orderkey").alias("game_id"),
        F.concat(F.lit("match_"), (F.col("o_custkey") % 50).cast("string")).alias("match_id"),
        F.when(even, "Lc0").otherwise("Reckless").alias("white"),
        F.when(even, "Reckless").otherwise("Lc0").alias("black"),
        F.when(F.col("o_orderstatus") == "F", "1-0").when(F.col("o_orderstatus") == "O", "0-1")
         .otherwise("1/2-1/2").alias("result"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Time forfeit").otherwise("Normal").alias("termination"),
        F.col("o_custkey").alias("white_player_id"),
        ((F.col("o_custkey") * 7) % 1000 + 1).alias("black_player_id"),
        (F.col("o_custkey") % 25).alias("eco_key"),
        F.col("o_orderdate").alias("played_at"))


def fx_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    # an order has at most a handful of lines: per-game windows are small groups; under the name that later steps group and join by
    w = Window.partitionBy("game_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    m = li.withColumnRenamed("l_orderkey", "game_id").select("game_id",
                  F.row_number().over(w).cast("bigint").alias("ply"),
                  (F.col("l_partkey") % 7).alias("c"),
                  (F.col("l_linenumber") + 8).alias("d"),
                  (F.col("l_suppkey") % 90).alias("s"),
                  (F.col("l_partkey") % 401 - 200).cast("int").alias("eval_cp"),
                  (F.col("l_partkey") % 401 - 200 + F.col("l_suppkey") % 350).cast("int").alias("best_cp"))
    c, d, s = F.col("c"), F.col("d").cast("string"), F.col("s")
    comment = (F.when(c == 0, F.lit("book")).when(c == 1, F.lit(""))
               .when(c == 2, F.concat(F.lit("+M"), d, F.lit("/"), d, F.lit(" 1.5s")))
               .when(c == 3, F.concat(F.lit("-0."), (s + 10).cast("string"), F.lit("/"), d, F.lit(" 0."),
                                      (s + 10).cast("string"), F.lit("s, Draw by adjudication")))
               .otherwise(F.concat(F.lit("+1."), (s + 10).cast("string"), F.lit("/"), d, F.lit(" "),
                                   (s + 1).cast("string"), F.lit(".25s"))))
    ply = F.col("ply")
    return m.select("game_id", "ply",
                    F.when(ply % 2 == 1, "w").otherwise("b").alias("turn"),
                    F.when(ply % 4 == 1, "e4").when(ply % 4 == 2, "e5").when(ply % 4 == 3, "Nf3")
                     .otherwise("Nc6").alias("move_san"),
                    "eval_cp", "best_cp", comment.alias("comment"))


def fx_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"),
                                                   F.col("c_name").alias("display_name"))


def fx_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("eco_key"),
                                                 F.col("n_name").alias("opening_name"))


# --- the same adapters as SQL (DuckDB and Spark SQL), for the oracle -----------

def _values(rows) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ",\n ".join("(" + ",".join(lit(v) for v in r) + ")" for r in rows)


SQL = {
    "fx_positions": f"SELECT * FROM (VALUES\n {_values(POSITIONS)}\n) AS t({', '.join(POSITION_COLS)})",
    "fx_engines": f"SELECT * FROM (VALUES\n {_values(ENGINES)}\n) AS t({', '.join(ENGINE_COLS)})",
    "fx_runs": f"SELECT * FROM (VALUES {_values(RUNS)}) AS t({', '.join(RUN_COLS)})",
    "fx_puzzles": """SELECT concat('p', CAST(p.p_partkey AS VARCHAR)) AS puzzle_id, p.p_partkey AS pos,
       f.fen_before, concat(f.first_move, ' ', f.solution) AS moves,
       f.fen_after AS fen, f.solution, f.solution_san,
       CAST(800 + (p.p_partkey * 37) % 2300 AS INT) AS rating,
       CAST((p.p_partkey * 13) % 201 - 100 AS INT) AS popularity,
       p.p_name AS themes, concat('https://example.org/', CAST(p.p_partkey AS VARCHAR)) AS game_url
FROM part p JOIN fx_positions f ON f.k = p.p_partkey % 8""",
    "fx_answers": """SELECT r.run_id, z.puzzle_id, z.pos, e.engine_name AS engine, e.engine_id,
       CASE WHEN (z.pos * 3 + e.eidx * 5 + r.ridx * 7) % 22 = 0 THEN '0000'
            WHEN (z.pos * 3 + e.eidx * 5 + r.ridx * 7) % 11 = 0 THEN 'a1b1'
            ELSE z.solution END AS engine_move,
       CAST(5 + (z.pos * 7 + e.eidx * 13) % 60 AS INT) AS depth,
       CAST(50000 * (1 + e.eidx) + (z.pos * 101) % 9973 AS DOUBLE) AS nps,
       CAST((z.pos * 31 + e.eidx * 17) % 487 AS DOUBLE) / 1000.0 AS elapsed_seconds
FROM fx_puzzles z CROSS JOIN fx_engines e CROSS JOIN fx_runs r""",
    "fx_evals": """SELECT a.run_id, a.puzzle_id, a.pos, z.fen, z.solution, a.engine_move,
       a.engine_move = z.solution AS is_correct,
       a.depth, a.nps, a.elapsed_seconds, z.rating, a.engine, a.engine_id
FROM fx_answers a JOIN fx_puzzles z ON a.puzzle_id = z.puzzle_id""",
    "fx_games": """SELECT o_orderkey AS game_id, concat('match_', CAST(o_custkey % 50 AS VARCHAR)) AS match_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Lc0' ELSE 'Reckless' END AS white,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Reckless' ELSE 'Lc0' END AS black,
       CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '0-1' ELSE '1/2-1/2' END AS result,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'Time forfeit' ELSE 'Normal' END AS termination,
       o_custkey AS white_player_id, (o_custkey * 7) % 1000 + 1 AS black_player_id,
       o_custkey % 25 AS eco_key, o_orderdate AS played_at
FROM orders""",
    "fx_moves": """SELECT game_id, ply, CASE WHEN ply % 2 = 1 THEN 'w' ELSE 'b' END AS turn,
       CASE ply % 4 WHEN 1 THEN 'e4' WHEN 2 THEN 'e5' WHEN 3 THEN 'Nf3' ELSE 'Nc6' END AS move_san,
       eval_cp, best_cp,
       CASE WHEN c = 0 THEN 'book' WHEN c = 1 THEN ''
            WHEN c = 2 THEN concat('+M', CAST(d AS VARCHAR), '/', CAST(d AS VARCHAR), ' 1.5s')
            WHEN c = 3 THEN concat('-0.', CAST(10 + s AS VARCHAR), '/', CAST(d AS VARCHAR), ' 0.', CAST(10 + s AS VARCHAR), 's, Draw by adjudication')
            ELSE concat('+1.', CAST(10 + s AS VARCHAR), '/', CAST(d AS VARCHAR), ' ', CAST(1 + s AS VARCHAR), '.25s') END AS comment
FROM (SELECT l_orderkey AS game_id,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ply,
             l_partkey % 7 AS c, l_linenumber + 8 AS d, l_suppkey % 90 AS s,
             CAST(l_partkey % 401 - 200 AS INT) AS eval_cp,
             CAST(l_partkey % 401 - 200 + l_suppkey % 350 AS INT) AS best_cp
      FROM lineitem) m""",
    "fx_players": "SELECT c_custkey AS player_id, c_name AS display_name FROM customer",
    "fx_openings": "SELECT CAST(n_nationkey AS BIGINT) AS eco_key, n_name AS opening_name FROM nation",
}

DEPENDS = {
    "fx_puzzles": ["fx_positions"],
    "fx_answers": ["fx_puzzles", "fx_engines", "fx_runs"],
    "fx_evals": ["fx_answers", "fx_puzzles"],
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every adapter it names (and their inputs)."""
    used = [n for n in SQL if n in sql]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{SQL[n]}\n)" for n in _closure(used))
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
