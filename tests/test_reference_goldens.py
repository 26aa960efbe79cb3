"""The reference's own test scenarios, re-expressed on Spark operators."""
import glob
import os
import tempfile

from pyspark.sql import functions as F

from knightshift import schemas
from knightshift.operators import rollups as R
from knightshift.operators import scoring as S
from knightshift.sinks.files import export_csv

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
AFTER_E4 = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 0 1"


def test_3nf_rollup_golden(spark):
    engines = spark.createDataFrame(
        [("stockfish_18", "Stockfish 18"), ("lc0_v0_32_1", "Lc0 v0.32.1")], "engine_id string, engine_name string")
    ev = spark.createDataFrame([
        ("run_test_01", "puz_01", "stockfish_18", True), ("run_test_01", "puz_02", "stockfish_18", True),
        ("run_test_01", "puz_01", "lc0_v0_32_1", True), ("run_test_01", "puz_02", "lc0_v0_32_1", False),
    ], "run_id string, puzzle_id string, engine_id string, is_correct boolean")
    got = {r.engine_name: r.accuracy_pct for r in R.rollup_3nf(ev, engines, "run_test_01").collect()}
    assert got == {"Stockfish 18": 100.0, "Lc0 v0.32.1": 50.0}


def test_score_and_manual_csv(spark):
    puzzles = spark.createDataFrame([("test_01", START, "e2e4", 2500), ("test_02", AFTER_E4, "e7e5", 2600)],
                                    "puzzle_id string, fen string, solution string, rating int")
    answers = spark.createDataFrame(
        [("r", "test_01", "e2e4", 20, 15000000.0, 0.05, "Stockfish 18"),
         ("r", "test_02", "e7e5", 22, 16000000.0, 0.06, "Stockfish 18")],
        "run_id string, puzzle_id string, engine_move string, depth int, nps double, elapsed_seconds double, engine string")
    ev = S.score_answers(puzzles, answers, evaluated_at="2026-01-01T00:00:00Z")
    assert ev.count() == 2 and "evaluated_at" in ev.columns
    from knightshift.functions.san import annotate_san
    ev = annotate_san(annotate_san(ev, "fen", "solution", "solution_san"), "fen", "engine_move", "engine_move_san")
    assert {r.engine_move_san for r in ev.collect()} == {"e4", "e5"}
    ev.createOrReplaceTempView("evals_test")
    out = tempfile.mkdtemp(prefix="ks-csv-")
    export_csv(spark, "SELECT engine, COUNT(*) AS total, ROUND(AVG(CASE WHEN is_correct THEN 1.0D ELSE 0.0D END)*100, 2) "
                      "AS accuracy_pct FROM evals_test GROUP BY engine", f"{out}/x", single_file=True)
    text = open(glob.glob(f"{out}/x/*.csv")[0]).read()
    assert "engine,total,accuracy_pct" in text and "Stockfish 18" in text


def test_expected_tables(spark):
    for name, schema in schemas.TABLES.items():
        spark.createDataFrame([], schema).createOrReplaceTempView(name)
    assert S.missing_tables(spark, schemas.EXPECTED_TABLES).count() == 0
    assert S.missing_tables(spark, schemas.EXPECTED_TABLES + ["nope"]).collect()[0][0] == "nope"


def test_engine_selection():
    assert S.normalize_engines(None) == ["Stockfish 18", "Pawnocchio 2.0.1", "Reckless 0.9.0", "Lc0 v0.32.1"]
    assert S.normalize_engines(" Stockfish 18 ,, Lc0 v0.32.1 ") == ["Stockfish 18", "Lc0 v0.32.1"]
    assert S.normalize_engines(["Stockfish 18,Lc0 v0.32.1"]) == ["Stockfish 18", "Lc0 v0.32.1"]
    assert os.path.sep  # keep import used
