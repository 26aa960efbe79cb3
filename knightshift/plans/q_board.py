"""Registered queries: move notation (P6) and the full evaluation record (J3 + P6)."""

from __future__ import annotations


from ..functions.san import annotate_san, annotate_san_columns
from ..operators.scoring import score_answers
from . import fixtures as fx
from .registry import query


@query("annotate_san", "SELECT puzzle_id, solution_san AS san FROM fx_puzzles")
def q_annotate_san(spark, d):
    z = fx.fx_puzzles(spark, d).select("puzzle_id", "fen", "solution")
    return annotate_san(z, "fen", "solution", out="san").select("puzzle_id", "san")


# engine answers are the solution, '0000' (no move) or 'a1b1'; 'a1b1' is legal only in
# position 6 (white rook a1, the h1 rook also reaches b1): 'Rab1'.  Hand-derived goldens.
@query("eval_results", """
SELECT a.run_id, a.puzzle_id, a.engine, a.engine_move,
       COALESCE(a.engine_move = z.solution, false) AS is_correct, z.solution_san,
       CASE WHEN a.engine_move = z.solution THEN z.solution_san
            WHEN a.engine_move = 'a1b1' AND z.pos % 8 = 6 THEN 'Rab1'
            ELSE a.engine_move END AS engine_move_san
FROM fx_answers a JOIN fx_puzzles z ON a.puzzle_id = z.puzzle_id""")
def q_eval_results(spark, d):
    puzzles = fx.fx_puzzles(spark, d)
    answers = fx.fx_answers(spark, d).select("run_id", "puzzle_id", "engine", "engine_move", "depth", "nps",
                                             "elapsed_seconds")
    ev = score_answers(puzzles, answers)
    ev = annotate_san_columns(ev, "fen", {"solution": "solution_san", "engine_move": "engine_move_san"})
    return ev.select("run_id", "puzzle_id", "engine", "engine_move", "is_correct", "solution_san", "engine_move_san")
