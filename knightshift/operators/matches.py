"""Engine-vs-engine match records: game text -> games, moves, scores (P11-P16, P18,
W4, W5, A8-A11, K5, K6, K9).

A game's moves stay inside its row as an ``array<struct>``: tokenizing,
pairing comments with moves, side-to-move and per-side averages are
higher-order functions over that array, so one pass over the text needs no
shuffle.  Games are numbered where they are read (W4); only per-match and
per-engine totals (A9-A11) shuffle, and those aggregate map-side first.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import comment_marks, first_turn, fixed, let, map_engine, marked_values
from ..sinks.files import in_match_order, write_matches

MOVES = ("array<struct<ply:int,move_number:int,turn:string,move_san:string,comment:string,"
         "eval:double,depth:int,seconds:double>>")

# --- fixed values ------------------------------------------------------------
# Defaults of missing headers.
DEFAULT_RESULT = "*"
DEFAULT_TERMINATION = "Normal"
# Tokens of movetext, in the order in which they are tried: a {comment} (whole, whatever it holds), the rest of a
# line after ';', variation brackets, numeric glyphs, castling, null moves, and SAN moves.
TOKEN_PATTERN = (r"(\{[^}]*\}?|;[^\n]*|\(|\)|\$\d+|O-O-O[+#]?|O-O[+#]?|--|"
                 r"[NBRQK]?[a-h]?[1-8]?[-x]?[a-h][1-8](?:=?[NBRQnbrq])?[+#]?)")
# Names of the telemetry headers.
TELEMETRY_TAGS = ["WhiteAvgDepth", "BlackAvgDepth", "WhiteAvgMoveTime", "BlackAvgMoveTime"]
ANNOTATOR_TAG = "Annotator"
# ------------------------------------------------------------------------------

HEADER_LINES = r"^((?:\s*\[[^\r\n]*\][ \t\r]*(?:\n|$))+)"
TAG_LINE = r'(?m)^\s*\[([A-Za-z0-9][A-Za-z0-9_+#=:-]*)\s+"([^\r\n]*)"\]'


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def header_section(pgn) -> Column:
    """The leading tag lines of a game."""
    return F.regexp_extract(_col(pgn), HEADER_LINES, 1)


def movetext(pgn) -> Column:
    """What follows the leading tag lines; brackets at line starts inside comments stay."""
    text = _col(pgn)
    return F.substr(text, F.length(header_section(text)) + 1)


def header(pgn, name: str) -> Column:
    """Value of a ``[Name "value"]`` tag line; null when the tag is absent."""
    line = r'(?m)^\s*\[' + name + r'\s+"([^\r\n]*)"\]'
    section = header_section(pgn)
    return F.when(section.rlike(line), F.regexp_extract(section, line, 1))


def with_headers(games: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """``games`` with columns that hold the ``header`` of their tag name: the tag lines are cut out once and looked through together."""
    lines = r'(?m)^\s*\[(' + "|".join(names.values()) + r')\s+"([^\r\n]*)"\]'
    t = games.withColumn("__head", header_section(column))
    t = t.withColumns({f"__t{k}": F.regexp_extract_all("__head", F.lit(lines), k) for k in (1, 2)})
    at = {k: F.array_position("__t1", name) for k, name in names.items()}
    return t.withColumns({k: F.when(pos > 0, F.element_at("__t2", pos.cast("int"))) for k, pos in at.items()}).drop("__head", "__t1", "__t2")


def main_line(tokens: Column) -> Column:
    """Moves and comments outside variations, whatever the nesting; glyphs and ';' comments dropped."""
    plain = F.filter(tokens, lambda t: ~t.startswith(";") & ~t.startswith("$"))

    def fold(own: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

        def step(s: Column, t: Column) -> Column:
            depth = F.when(t == "(", s["depth"] + 1).when(t == ")", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
            keep = (s["depth"] == 0) & ~t.isin("(", ")")
            return F.struct(depth.alias("depth"), F.when(keep, F.array_append(s["kept"], t)).otherwise(s["kept"]).alias("kept"))

        folded = F.aggregate(own, start, step)["kept"]
        brackets = F.array_contains(own, "(") | F.array_contains(own, ")")
        return F.when(brackets, folded).otherwise(own)      # games without variations need no fold

    return let(plain, fold)


def parse_games(games_text: DataFrame) -> DataFrame:
    """S8 -> P12, P15, W5: one row per game with headers, number of plies and move array.

    Input: (match_id, game_no, pgn) as produced by ``read_games_text``.  All comments between a move and the
    next one of the main line belong to that move, joined by a blank.
    """
    # every tag in one regex pass over the header lines: names and values as two aligned arrays
    t = games_text.withColumn("__head", header_section("pgn"))
    # a repeated tag keeps its last value, as a header dictionary would
    t = t.withColumns({"__tk": F.reverse(F.regexp_extract_all("__head", F.lit(TAG_LINE), 1)),
                       "__tv": F.reverse(F.regexp_extract_all("__head", F.lit(TAG_LINE), 2))})

    def tag(name: str) -> Column:
        pos = F.array_position("__tk", name)
        return F.when(pos > 0, F.element_at("__tv", pos.cast("int")))

    body = F.substr("pgn", F.length("__head") + 1)
    g = t.select(
        "match_id", "game_no", "pgn",
        tag("White").alias("white"), tag("Black").alias("black"),
        F.coalesce(tag("Result"), F.lit(DEFAULT_RESULT)).alias("result"),
        F.coalesce(tag("Termination"), F.lit(DEFAULT_TERMINATION)).alias("termination"),
        tag("PlyCount").alias("ply_count"), tag("Round").alias("round"), tag("FEN").alias("fen"),
        tag("GameStartTime").alias("start_time"), tag("GameEndTime").alias("end_time"),
        F.regexp_extract_all(body, F.lit(TOKEN_PATTERN), 1).alias("toks"))
    g = g.withColumn("first_turn", first_turn(F.coalesce("fen", F.lit(""))))
    g = g.withColumn("full0", F.coalesce(F.split(F.col("fen"), " ").getItem(5).try_cast("int"), F.lit(1)))
    g = g.withColumn("line", main_line(F.col("toks"))).drop("toks")
    g = g.withColumn("plies", F.size(F.filter("line", lambda x: ~x.startswith("{"))))
    first_white = F.col("first_turn") == "w"

    def all_moves(at: Column) -> Column:
        def move_row(start, k):
            ply = k + 1
            after = F.slice("line", start + 1, F.coalesce(F.get(at, k + 1), F.size("line") + 1) - start - 1)
            # a comment token is '{...}': strip the braces without a regex
            texts = F.transform(after, lambda c: F.trim(F.rtrim(F.substr(c, F.lit(2), F.length(c)), F.lit("}"))))
            white_move = F.when(first_white, ply % 2 == 1).otherwise(ply % 2 == 0)
            move_no = F.when(first_white, F.col("full0") + F.floor((ply - 1) / 2)) \
                       .otherwise(F.col("full0") + F.floor(ply / 2))
            return F.struct(ply.cast("int").alias("ply"), move_no.cast("int").alias("move_number"),
                            F.when(white_move, "w").otherwise("b").alias("turn"),
                            F.element_at("line", start).alias("move_san"),
                            F.array_join(F.filter(texts, lambda c: c != ""), " ").alias("comment"))
        return F.transform(at, move_row)

    own = ["ply", "move_number", "turn", "move_san", "comment"]

    def with_marks(m):
        # second pass: the comment is a stored field now, each pattern goes over it once
        return F.struct(*[m[c].alias(c) for c in own], *comment_marks(m["comment"]))

    def with_telemetry(m):
        return F.struct(*[m[c].alias(c) for c in own], *marked_values(m["found"], m["took"]))

    places = F.filter(F.transform("line", lambda x, i: F.when(~x.startswith("{"), i + 1)), lambda i: i.isNotNull())
    moves = F.when(F.size("line") > 0, F.transform(F.transform(let(places, all_moves), with_marks), with_telemetry))
    return g.withColumn("moves", F.coalesce(moves, F.array().cast(MOVES))).drop("line")


def explode_moves(games: DataFrame, keys=("match_id", "game_no")) -> DataFrame:
    """One row per ply (the array is in ply order).

    The generator reads ``array_compact(moves)`` (the same array: moves are
    never null) so the optimizer cannot split the struct fields back into
    separate copies of the per-game parsing expression (7x slower)."""
    return games.select(*keys, F.inline(F.array_compact("moves")))


def _side_avg(moves: Column, side: str, field: str) -> Column:
    vals = F.filter(F.transform(moves, lambda m: F.when(m["turn"] == side, m[field].cast("double"))),
                    lambda v: v.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(vals) > 0, total / F.size(vals))


def side_stats(games: DataFrame) -> DataFrame:
    """Mean depth and mean seconds per side, nulls skipped; null when a side has none.

    The sums run left to right like the reference's Python loop, so the
    doubles are bit-identical to it.
    """
    m = F.col("moves")
    return games.withColumns({
        "white_avg_depth": _side_avg(m, "w", "depth"),
        "black_avg_depth": _side_avg(m, "b", "depth"),
        "white_avg_movetime_sec": _side_avg(m, "w", "seconds"),
        "black_avg_movetime_sec": _side_avg(m, "b", "seconds"),
    })


def game_table(games: DataFrame, engine1: str, engine2: str, load_ts: str) -> DataFrame:
    """engine_match_games rows (P12-P16, A8): one per game."""
    s = side_stats(games)
    plies = F.coalesce(F.col("ply_count").try_cast("int"), F.col("plies"))
    rnd = F.coalesce(F.col("round").try_cast("int"), F.col("game_no").cast("int"))
    return s.select(
        F.concat(F.col("match_id"), F.lit("_g"), F.col("game_no").cast("string")).alias("game_id"),
        "match_id", rnd.alias("round_number"),
        map_engine(F.coalesce("white", F.lit("")), F.lit(engine1), F.lit(engine2)).alias("white_engine_id"),
        map_engine(F.coalesce("black", F.lit("")), F.lit(engine2), F.lit(engine1)).alias("black_engine_id"),
        "result", plies.alias("total_plies"),
        "white_avg_depth", "black_avg_depth", "white_avg_movetime_sec", "black_avg_movetime_sec",
        "termination", enriched("pgn").alias("moves_pgn"),
        F.coalesce("end_time", F.lit(load_ts)).alias("played_at"),
        "game_no", "start_time", "end_time", "first_turn")


def match_table(game_rows: DataFrame, engine1: str, engine2: str, time_control: str,
                total_rounds: int, load_ts: str) -> DataFrame:
    """Per match score of engine1 / engine2, draws, first start and last end.

    Score rules follow the match runner: a decisive game not won by engine1
    counts for engine2.
    """
    e1 = engine1.lower()
    r = F.col("result")
    e1_pts = (F.when((r == "1-0") & (F.col("white_engine_id") == e1), 1.0)
              .when((r == "0-1") & (F.col("black_engine_id") == e1), 1.0)
              .when(r == "1/2-1/2", 0.5).otherwise(0.0))
    e2_pts = (F.when((r == "1-0") & (F.col("white_engine_id") != e1), 1.0)
              .when((r == "0-1") & (F.col("black_engine_id") != e1), 1.0)
              .when(r == "1/2-1/2", 0.5).otherwise(0.0))
    agg = game_rows.groupBy("match_id").agg(
        F.sum(e1_pts).alias("engine1_score"), F.sum(e2_pts).alias("engine2_score"),
        F.sum(F.when(r == "1/2-1/2", 1).otherwise(0)).cast("int").alias("draws"),
        F.min_by("start_time", F.when(F.col("start_time").isNotNull(), F.col("game_no"))).alias("first_start"),
        F.max_by("end_time", F.when(F.col("end_time").isNotNull(), F.col("game_no"))).alias("last_end"))
    return agg.select(
        "match_id", F.lit(e1).alias("engine1_id"), F.lit(engine2.lower()).alias("engine2_id"),
        F.lit(time_control).alias("time_control"), F.lit(total_rounds).cast("int").alias("total_rounds"),
        F.lit(1).alias("concurrency"), "engine1_score", "engine2_score", "draws",
        F.concat(F.lit("db://engine_match_games_"), F.col("match_id"), F.lit(".parquet")).alias("pgn_path"),
        F.coalesce("first_start", F.lit(load_ts)).alias("started_at"),
        F.coalesce("last_end", F.lit(load_ts)).alias("completed_at"))


def ingest_games(games_text: DataFrame, engine1: str, engine2: str, time_control: str,
                 total_rounds: int, load_ts: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Match text -> (engine_matches, engine_match_games, game_moves), not stored."""
    parsed = parse_games(games_text)
    games = game_table(parsed, engine1, engine2, load_ts)
    matches = match_table(games, engine1, engine2, time_control, total_rounds, load_ts)
    moves = explode_moves(parsed.withColumn(
        "game_id", F.concat(F.col("match_id"), F.lit("_g"), F.col("game_no").cast("string"))), keys=("game_id",))
    return matches, games.drop("start_time", "end_time", "first_turn"), moves


def store_games(games_text: DataFrame, root: str, engine1: str, engine2: str, time_control: str,
                total_rounds: int, load_ts: str) -> tuple[str, str]:
    """K3: parse the match text once and store both tables; returns (matches path, games path)."""
    games = game_table(parse_games(in_match_order(games_text)), engine1, engine2, load_ts)
    return write_matches(games, lambda g: match_table(g, engine1, engine2, time_control, total_rounds, load_ts), root)


def standings(games: DataFrame, white: str = "white", black: str = "black", result: str = "result") -> DataFrame:
    """A10: wins / draws / losses per engine (lower-cased names) over all games."""
    r = F.col(result)
    sides = F.array(
        F.struct(F.lower(F.col(white)).alias("engine"),
                 F.when(r == "1-0", "W").when(r == "0-1", "L").when(r == "1/2-1/2", "D").alias("o")),
        F.struct(F.lower(F.col(black)).alias("engine"),
                 F.when(r == "0-1", "W").when(r == "1-0", "L").when(r == "1/2-1/2", "D").alias("o")))
    rows = games.select(F.inline(sides))
    return rows.groupBy("engine").agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(F.col("o") == "W").alias("wins"),
        F.count_if(F.col("o") == "D").alias("draws"),
        F.count_if(F.col("o") == "L").alias("losses"))


def summary_line(wdl: DataFrame) -> DataFrame:
    """K9: 'ENGINE_SCORE: +W =D -L (WW-DD-LL)' per engine."""
    return wdl.withColumn("summary", F.format_string(
        "%s_SCORE: +%d =%d -%d (%dW-%dD-%dL)", F.col("engine"), F.col("wins"), F.col("draws"),
        F.col("losses"), F.col("wins"), F.col("draws"), F.col("losses")))


def color_balance(games: DataFrame, match: str = "match_id", white: str = "white", black: str = "black") -> DataFrame:
    """Games as White and as Black per (match, engine); balanced when equal."""
    sides = F.array(F.struct(F.lower(F.col(white)).alias("engine"), F.lit(1).alias("w"), F.lit(0).alias("b")),
                    F.struct(F.lower(F.col(black)).alias("engine"), F.lit(0).alias("w"), F.lit(1).alias("b")))
    rows = games.select(match, F.inline(sides))
    out = rows.groupBy(match, "engine").agg(F.sum("w").cast("bigint").alias("white_games"),
                                            F.sum("b").cast("bigint").alias("black_games"))
    return out.withColumn("balanced", F.col("white_games") == F.col("black_games"))


def pair_games(games: DataFrame, white: str = "white", black: str = "black") -> DataFrame:
    """Games played per unordered engine pair (planned = pairs x rounds)."""
    a, b = F.lower(F.col(white)), F.lower(F.col(black))
    return (games.select(F.least(a, b).alias("engine_a"), F.greatest(a, b).alias("engine_b"))
            .groupBy("engine_a", "engine_b").agg(F.count(F.lit(1)).alias("games")))


def with_tags(pgn, lines: Column) -> Column:
    """``pgn`` with the telemetry headers of ``lines`` (tag lines joined by line breaks) after its own headers;
    headers of these names that it has already are replaced."""
    text = F.trim(_col(pgn))
    names = [*TELEMETRY_TAGS, ANNOTATOR_TAG]
    line = r'(?m)^\s*\[(' + "|".join(names) + r')\s+"[^\r\n]*"\][ \t\r]*(\n|$)'

    section = header_section(text)
    held = reduce(operator.or_, (section.contains(n) for n in names))
    own = F.when(held, F.regexp_replace(section, line, "")).otherwise(section)
    return F.concat(F.rtrim(own, F.lit(" \t\r\n")), F.lit("\n"), lines, F.lit("\n\n"),
                    F.btrim(F.substr(text, F.length(section) + 1), F.lit(" \t\r\n")))


def _tag_line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'[{name} "'), value, F.lit('"]'))


def telemetry_lines(blank: bool, annotator: str = "telemetry engine") -> Column:
    """The telemetry tag lines from the side averages; a side without values gives 0.0 lines if ``blank``, else none."""
    values = {"WhiteAvgDepth": ("white_avg_depth", 1, ""), "BlackAvgDepth": ("black_avg_depth", 1, ""),
              "WhiteAvgMoveTime": ("white_avg_movetime_sec", 3, "s"), "BlackAvgMoveTime": ("black_avg_movetime_sec", 3, "s")}
    lines = []
    for name, (column, digits, unit) in values.items():
        x = F.coalesce(F.col(column), F.lit(0.0)) if blank else F.col(column)       # a line without a value is null: left out
        lines.append(_tag_line(name, F.concat(fixed(x, digits), F.lit(unit))))
    return F.concat_ws("\n", *lines, _tag_line(ANNOTATOR_TAG, F.lit(annotator)))


def enriched(pgn) -> Column:
    """K3: the stored game text: telemetry headers for sides that have values, and the annotator."""
    return with_tags(pgn, telemetry_lines(blank=False))


def annotate(games: DataFrame, annotator: str = "telemetry engine") -> DataFrame:
    """K6: the telemetry header lines set on every game (0.0 when a side has none); a second run changes nothing."""
    return side_stats(games).withColumn("annotated_pgn", with_tags("pgn", telemetry_lines(True, annotator)))
