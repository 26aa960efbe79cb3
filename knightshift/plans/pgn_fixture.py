"""Match text built from the game/move adapters (FIXTURES.md: "PGN text = fx_games
headers + ordered fx_moves joined per game"), written as files and read back.

Deterministic shaping rules (also spelled out in the oracle SQL):
* a 'Time forfeit' game starts from a position with Black to move (FEN tag) and
  has ``Round "?"``; other games carry their id as Round;
* a '1-0' game carries PlyCount; a drawn game has no GameStartTime tag;
* every third game has escaped quotes and brackets in its Event value;
* even games carry a second comment, with brackets, a ';' and a glyph in it, after
  every fourth ply from the third; games divisible by 5 carry a variation nested
  five deep, with comments, after the first ply; games divisible by 7 carry a
  ';' comment and a glyph after the second ply;
* a file holds at most ``GAMES_PER_FILE`` games, so a match spans several files; of more than ``FILES`` times as
  many games, as many more as keep the number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import landed
from ..sinks.files import game_slices, write_games_text
from . import fixtures as fx

GAMES_PER_FILE = 100
FILES = 2_000
NOTE = "note; (see [%x 1] $2"
VARIATION = " (1. d4 {+9.99/99 9.9s} (1. c4 {(} (1. b3 (1. a3 (1. h3 h6) a6) b6) c5) d5)"
LINE_COMMENT = " $14 ; Nf6 {not a move} (\n"
BLACK_START_FEN = "4k3/8/8/8/8/8/8/4K3 b - - 0 1"


def pgn_games(spark: SparkSession, d: str) -> DataFrame:
    """The games with their moves ``mv`` and the ``slice`` in which they are written."""
    g = game_slices(fx.fx_games(spark, d))
    mv = (fx.fx_moves(spark, d).groupBy("game_id")
          .agg(F.sort_array(F.collect_list(F.struct("ply", "move_san", "comment"))).alias("mv")))
    return g.join(mv, "game_id", "left").withColumn("mv", F.coalesce("mv", F.array().cast(
        "array<struct<ply:bigint,move_san:string,comment:string>>")))


def pgn_text() -> Column:
    """The text of a game of ``pgn_games``."""
    black_start = F.col("termination") == "Time forfeit"

    def token(m):
        ply = m["ply"]
        white_move = F.when(black_start, ply % 2 == 0).otherwise(ply % 2 == 1)
        num = F.when(black_start, F.floor(ply / 2) + 1).otherwise(F.floor((ply + 1) / 2)).cast("string")
        prefix = (F.when(white_move, F.concat(num, F.lit(". ")))
                  .when(ply == 1, F.concat(num, F.lit("... "))).otherwise(F.lit("")))
        com = F.when(m["comment"] != "", F.concat(F.lit(" {"), m["comment"], F.lit("}"))).otherwise(F.lit(""))
        note = F.when((ply % 4 == 3) & (F.col("game_id") % 2 == 0), F.lit(" {" + NOTE + "}")).otherwise(F.lit(""))
        var = F.when((ply == 1) & (F.col("game_id") % 5 == 0), F.lit(VARIATION)).otherwise(F.lit(""))
        rest = F.when((ply == 2) & (F.col("game_id") % 7 == 0), F.lit(LINE_COMMENT)).otherwise(F.lit(""))
        return F.concat(prefix, m["move_san"], com, var, note, rest)

    moves_text = F.array_join(F.transform("mv", token), " ")
    tag = lambda k, v: F.format_string('[%s "%s"]', F.lit(k), v)
    tags = F.concat_ws(
        "\n",
        tag("Event", F.when(F.col("game_id") % 3 == 0, F.concat(F.col("match_id"), F.lit(' \\"cup\\" [final]')))
            .otherwise(F.col("match_id"))),
        tag("Site", F.concat(F.lit("game "), F.col("game_id").cast("string"))),
        tag("Round", F.when(black_start, F.lit("?")).otherwise(F.col("game_id").cast("string"))),
        tag("White", F.col("white")), tag("Black", F.col("black")), tag("Result", F.col("result")),
        F.when(black_start, tag("FEN", F.lit(BLACK_START_FEN))),
        F.when(F.col("result") == "1-0", tag("PlyCount", F.size("mv").cast("string"))),
        tag("Termination", F.col("termination")),
        F.when(F.col("result") != "1/2-1/2",
               tag("GameStartTime", F.date_format("played_at", "yyyy-MM-dd'T'00:00:00"))),
        tag("GameEndTime", F.date_format("played_at", "yyyy-MM-dd'T'HH:mm:ss")))
    return F.concat(tags, F.lit("\n\n"), F.trim(F.concat(moves_text, F.lit(" "), F.col("result"))), F.lit("\n"))


def pgn_files(spark: SparkSession, d: str) -> str:
    """Write the match files (one directory per match) and return their root."""
    per_file = max(GAMES_PER_FILE, -(-fx.table(spark, d, "orders").count() // FILES))
    return landed(spark, f"pgn:{d}", lambda path: write_games_text(pgn_games(spark, d), path, per_file, pgn_text()))


# SQL pieces for oracles over the adapters
GAME_NO = "row_number() OVER (PARTITION BY match_id ORDER BY game_id)"
BLACK_START = "termination = 'Time forfeit'"
