"""Move-level analytics and game facts.

Per-game windows are over small, bounded groups (the plies of one game);
dimension joins broadcast only a side whose row count was checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.joins import bounded_broadcast

# Judgment thresholds in centipawns (parameters: the data model names the
# classes but not the limits).
JUDGMENT_LIMITS = {"inaccuracy": 50, "mistake": 100, "blunder": 300}
JUDGMENTS = ["best", "inaccuracy", "mistake", "blunder"]


def centipawn_loss(moves: DataFrame, game: str = "game_id", ply: str = "ply") -> DataFrame:
    """Eval swing against the previous ply and the mover's loss against the best line.

    Evaluations are from White's view: White loses ``best - played``, Black
    ``played - best``; never below zero.
    """
    w = Window.partitionBy(game).orderBy(ply)
    white = F.col("turn") == "w"
    loss = F.when(white, F.col("best_cp") - F.col("eval_cp")).otherwise(F.col("eval_cp") - F.col("best_cp"))
    return moves.select("*", (F.col("eval_cp") - F.lag("eval_cp").over(w)).alias("eval_swing"),
                        F.greatest(F.lit(0), loss).alias("centipawn_loss"))


def judgment(loss_col: str = "centipawn_loss", limits=JUDGMENT_LIMITS):
    c = F.col(loss_col)
    return (F.when(c >= limits["blunder"], "blunder").when(c >= limits["mistake"], "mistake")
            .when(c >= limits["inaccuracy"], "inaccuracy").otherwise("best"))


def acpl(moves_with_loss: DataFrame, by=("game_id", "turn")) -> DataFrame:
    """Average centipawn loss."""
    return moves_with_loss.groupBy(*by).agg(F.avg("centipawn_loss").alias("acpl"),
                                            F.count(F.lit(1)).alias("moves"))


def judgment_counts(moves_with_loss: DataFrame, by=("turn",), limits=JUDGMENT_LIMITS) -> DataFrame:
    """Number of moves per judgment class (one column per class)."""
    j = moves_with_loss.withColumn("judgment", judgment("centipawn_loss", limits))
    out = j.groupBy(*by).pivot("judgment", JUDGMENTS).agg(F.count(F.lit(1)))
    return out.fillna(0, subset=JUDGMENTS)


def game_facts(games: DataFrame, players: DataFrame, openings: DataFrame) -> DataFrame:
    """Games with both player names and the (nullable) opening."""
    p = bounded_broadcast(players.select("player_id", "display_name"))
    o = bounded_broadcast(openings.select("eco_key", "opening_name"))
    wp = p.select(F.col("player_id").alias("white_player_id"), F.col("display_name").alias("white_name"))
    bp = p.select(F.col("player_id").alias("black_player_id"), F.col("display_name").alias("black_name"))
    return (games.join(wp, "white_player_id", "left").join(bp, "black_player_id", "left")
            .join(o, "eco_key", "left"))


def move_facts(games: DataFrame, moves: DataFrame) -> DataFrame:
    """Every move with its game's players and result (equi join on game_id)."""
    return moves.join(games.select("game_id", "white", "black", "result"), "game_id")


def results_by_opening(facts: DataFrame) -> DataFrame:
    """Results per opening."""
    r = F.col("result")
    return facts.groupBy("opening_name").agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(r == "1-0").alias("white_wins"), F.count_if(r == "1/2-1/2").alias("draws"),
        F.count_if(r == "0-1").alias("black_wins"))


def results_by_player(games: DataFrame, players: DataFrame) -> DataFrame:
    """Games and points per player over both colours (points summed map-side, then named)."""
    r = F.col("result")
    sides = F.array(
        F.struct(F.col("white_player_id").alias("player_id"),
                 F.when(r == "1-0", 1.0).when(r == "1/2-1/2", 0.5).when(r == "0-1", 0.0).alias("pts")),
        F.struct(F.col("black_player_id").alias("player_id"),
                 F.when(r == "0-1", 1.0).when(r == "1/2-1/2", 0.5).when(r == "1-0", 0.0).alias("pts")))
    per = games.select(F.inline(sides)).groupBy("player_id").agg(
        F.count(F.lit(1)).alias("games"), F.sum("pts").alias("points"))
    p = bounded_broadcast(players.select("player_id", "display_name"))
    return per.join(p, "player_id", "left")
