"""Board transitions (P5) and notation (P6) on hand-derived goldens."""
from knightshift.functions.board import apply_move
from knightshift.functions.san import annotate_san
from knightshift.plans.fixtures import POSITIONS


def test_apply_move_goldens(spark):
    df = spark.createDataFrame([(k, fb, m, fa) for k, fb, m, fa, _, _ in POSITIONS],
                               "k int, fen string, mv string, exp string")
    for r in apply_move(df, "fen", "mv").collect():
        assert r.fen_after == r.exp, r.k


def test_apply_move_rejects(spark):
    df = spark.createDataFrame([("not a fen", "e2e4"), ("8/8/8/8/8/8/8/4K2k w - - 0 1", "z9z9"),
                                ("8/8/8/8/8/8/8/4K2k w - - 0 1", "a1a2")], "fen string, mv string")
    assert [r.fen_after for r in apply_move(df, "fen", "mv").collect()] == [None, None, None]


def test_san_goldens(spark):
    rows = [(fa, sol, san) for _, _, _, fa, sol, san in POSITIONS]
    rows += [("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "e2e4", "e4"),
             ("r1bqk2r/pppp1ppp/2n5/1B2p3/4n3/5N2/PPPP1PPP/RNBQK2R w KQkq - 0 5", "d1e2", "Qe2"),
             ("r1bqk2r/pppp1ppp/2n5/1B2p3/4n3/5N2/PPPP1PPP/RNBQK2R w KQkq - 0 5", "e1g1", "O-O"),
             ("r3k2r/8/8/8/8/8/8/R3K2R b KQkq - 0 1", "e8c8", "O-O-O"),
             ("8/P6k/8/8/8/8/7K/8 w - - 0 1", "a7a8q", "a8=Q"),
             ("8/P6k/8/8/8/8/7K/8 w - - 0 1", "a7a8", "a7a8"),
             ("7k/8/8/8/8/8/8/R3K1R1 w - - 0 1", "a1a8", "Ra8+"),
             ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", "0000", "0000"),
             ("not a fen", "e2e4", "e2e4")]
    df = spark.createDataFrame(rows, "fen string, mv string, exp string")
    for r in annotate_san(df, "fen", "mv").collect():
        assert r.san == r.exp, (r.fen, r.mv)
