"""Scalar column functions (Column in, Column out), all JVM-side built-ins.

These are the per-row rules of the benchmark data model: answer scoring,
safe identifiers, engine families, comment telemetry, result points and the
report texts.  None of them needs Python at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
# Telemetry written by match software after each move, e.g. "+0.86/16 0.49s":
# the first pattern finds "eval/depth" (mate scores carry a leading '#'),
# the second the thinking time in seconds.
EVAL_DEPTH_PATTERN = r"([+-]?\d+\.?\d*|\#?[+-]?\d+)/(\d+)"
SECONDS_PATTERN = r"(\d+\.?\d*)s"
# Engines every run uses when none are given.
DEFAULT_ENGINES = ["Stockfish 18", "Pawnocchio 2.0.1", "Reckless 0.9.0", "Lc0 v0.32.1"]
# Engine families by lower-case name substring, first match wins.
ENGINE_FAMILIES = [("lc0", "lc0"), ("leela", "lc0"), ("stockfish", "stockfish"),
                   ("reckless", "reckless"), ("pawnocchio", "pawnocchio")]
# Accuracy bands of the live view (percent) and of the summary report.
LIVE_BAND_HIGH, LIVE_BAND_MID = 98.0, 90.0
REPORT_BAND = 99.0
# ------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once (a one-element array binds it)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def is_correct(engine_move, solution) -> Column:
    """Exact string equality; a missing answer is wrong, never null."""
    return F.coalesce(_c(engine_move) == _c(solution), F.lit(False))


def safe_name(name) -> Column:
    """Lower case, spaces and dots to underscores ('Lc0 v0.32.1' -> 'lc0_v0_32_1')."""
    return F.translate(F.lower(_c(name)), " .", "__")


def engine_family(name) -> Column:
    """Engine family from its display name; 'other' when unknown."""
    low = F.lower(_c(name))
    expr = None
    for needle, fam in ENGINE_FAMILIES:
        cond = low.contains(needle)
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    return expr.otherwise(F.lit("other"))


def parse_comment(comment) -> Column:
    """struct(eval, depth, seconds) from a move comment; nulls where absent."""
    c = _c(comment)
    ev_txt = F.nullif(F.regexp_extract(c, EVAL_DEPTH_PATTERN, 1), F.lit(""))
    dp_txt = F.nullif(F.regexp_extract(c, EVAL_DEPTH_PATTERN, 2), F.lit(""))
    sec_txt = F.nullif(F.regexp_extract(c, SECONDS_PATTERN, 1), F.lit(""))
    ev_val = _try_cast(F.replace(ev_txt, F.lit("#"), F.lit("")), "double")
    dp_val = F.when(ev_val.isNotNull(), _try_cast(dp_txt, "int"))
    sec_val = _try_cast(sec_txt, "double")
    return F.struct(ev_val.alias("eval"), dp_val.alias("depth"), sec_val.alias("seconds"))


def comment_marks(comment) -> list[Column]:
    """First half of ``parse_comment`` for lambdas, where nothing is shared: the texts ``found`` ("eval/depth") and ``took``, a pass each."""
    c = _c(comment)
    return [F.regexp_extract(c, EVAL_DEPTH_PATTERN, 0).alias("found"), F.regexp_extract(c, SECONDS_PATTERN, 1).alias("took")]


def marked_values(found: Column, took: Column) -> list[Column]:
    """Second half: eval, depth and seconds of ``comment_marks``.  The parts of ``found`` hold no other slash; a cast of no text is costly."""
    ev_val = F.when(found != "", _try_cast(F.replace(F.substring_index(found, "/", 1), F.lit("#"), F.lit("")), "double"))
    dp_val = F.when(ev_val.isNotNull(), _try_cast(F.substring_index(found, "/", -1), "int"))
    return [ev_val.alias("eval"), dp_val.alias("depth"), F.when(took != "", _try_cast(took, "double")).alias("seconds")]


def py_int(text) -> Column:
    """Integer text as Python's ``int()`` reads it (sign, surrounding blanks, ``_``
    between digit groups); null when it does not parse or does not fit."""
    t = _c(text)
    ok = t.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$")
    return F.when(ok, F.regexp_replace(F.trim(t), "_", "").try_cast("int"))


def _try_cast(c: Column, to: str) -> Column:
    return c.try_cast(to)


def map_engine(name, first, second) -> Column:
    """Engine id of a player: ``first`` if its name contains it, else
    ``second`` if it does, else the lower-cased name itself."""
    low = F.lower(_c(name))
    a, b = F.lower(_c(first)), F.lower(_c(second))
    return F.when(low.contains(a), a).when(low.contains(b), b).otherwise(low)


def white_points(result) -> Column:
    """Points of White (1, 0.5, 0); null for an unfinished game ('*')."""
    r = _c(result)
    return (F.when(r == "1-0", F.lit(1.0)).when(r == "0-1", F.lit(0.0))
            .when(r == "1/2-1/2", F.lit(0.5)))


def black_points(result) -> Column:
    return F.lit(1.0) - white_points(result)


FEN_SHAPE = r"^([pnbrqkPNBRQK1-8]+/){7}[pnbrqkPNBRQK1-8]+ [wb]( |$)"


def first_turn(fen) -> Column:
    """Side to move at the start: from the FEN header, white when absent or malformed."""
    f = _c(fen)
    side = F.split(f, " ").getItem(1)
    return F.when(f.rlike(FEN_SHAPE) & (side == "b"), F.lit("b")).otherwise(F.lit("w"))


def fixed(x, digits: int) -> Column:
    """``f"{x:.{digits}f}"`` exactly as Python / C printf write it (round half even on the
    exact binary value), not Java's half-up on the shortest decimal text.

    The product ``x * 10**digits`` is split into its double ``p`` and exact error
    ``err`` (Dekker's two-product), which decides the only ambiguous case,
    ``p`` landing exactly on a half.  Valid for ``|x| * 10**digits < 2**52``.
    """
    v = _c(x)
    a = F.abs(v)
    s = float(10 ** digits)
    p = a * F.lit(s)
    c = a * F.lit(134217729.0)
    hi = c - (c - a)
    lo = a - hi
    err = (hi * F.lit(s) - p) + lo * F.lit(s)
    fl = F.floor(p)
    r = p - fl
    up = (F.when(r > 0.5, True).when(r < 0.5, False)
          .when(err > 0, True).when(err < 0, False)
          .otherwise(fl % 2 == 1))
    n = (fl + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("long")
    body = n.cast("string") if digits == 0 else F.concat(
        (n / F.lit(10 ** digits)).cast("long").cast("string"), F.lit("."),
        F.lpad((n % F.lit(10 ** digits)).cast("string"), digits, "0"))
    # null stays null on the way: behind a condition on it, nothing that the steps share would be worked out once
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), body)


def speed_label(nps) -> Column:
    """Compact speed text: '18.8M', '57k', '950' (Python rounding)."""
    n = _c(nps)
    return (F.when(n >= 1e6, F.concat(fixed(n / 1e6, 1), F.lit("M")))
            .when(n >= 1e3, F.concat(fixed(n / 1e3, 0), F.lit("k")))
            .otherwise(fixed(n, 0)))


def live_band(accuracy_pct) -> Column:
    """Accuracy band of the live view."""
    a = _c(accuracy_pct)
    return (F.when(a >= LIVE_BAND_HIGH, F.lit("high")).when(a >= LIVE_BAND_MID, F.lit("medium"))
            .otherwise(F.lit("low")))


def report_band(accuracy_pct) -> Column:
    """P20: band of the summary report."""
    return F.when(_c(accuracy_pct) >= REPORT_BAND, F.lit("high")).otherwise(F.lit("medium"))


def solved_of_total(solved, total) -> Column:
    """P20: '4,989 / 5,005' (grouping with ',' whatever the JVM locale)."""
    return F.concat(F.format_number(_c(solved), 0), F.lit(" / "), F.format_number(_c(total), 0))


def round_half_away(x, digits: int) -> Column:
    """ROUND as the reference's SQL engine computes it on DOUBLE: the product
    ``x * 10**digits`` (a double) rounded half away from zero, divided back.
    Spark's ``round`` instead rounds the shortest decimal text half up, which
    differs on values such as 0.285 (binary 0.28499...)."""
    v = _c(x).cast("double")
    m = float(10 ** digits)
    y = F.abs(v) * F.lit(m)
    fl = F.floor(y).cast("double")
    r = fl + F.when(y - fl >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(v < 0, -r).otherwise(r) / F.lit(m)


def bool_avg_pct(flag, digits: int = 2) -> Column:
    """ROUND(AVG(CASE WHEN flag THEN 1.0 ELSE 0.0 END) * 100.0, digits) with DOUBLE arithmetic."""
    return round_half_away(F.avg(F.when(_c(flag), F.lit(1.0)).otherwise(F.lit(0.0)).cast("double")) * 100.0, digits)


def count_true(flag) -> Column:
    """SUM(CASE WHEN flag THEN 1 ELSE 0 END) as BIGINT."""
    return F.sum(F.when(_c(flag), F.lit(1)).otherwise(F.lit(0))).cast("bigint")
