"""Chess positions as native column expressions (P5 apply move; building blocks of P6).

A position's placement is expanded to a 64-character string, a8 first and h1
last, '1' for an empty square.  Square (file f, rank r), both 0-based with
rank 0 = rank "1", sits at index ``(7 - r) * 8 + f``.  Moves are applied with
``overlay``; an attack test is one ``exists`` over the squares of that string.
Nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOARD_ROWS = r"^([pnbrqkPNBRQK1]{8}/){7}[pnbrqkPNBRQK1]{8}$"
UCI_SHAPE = r"^[a-h][1-8][a-h][1-8][pnbrqk]?$"
CASTLING_SHAPE = r"^(-|[KQA-H]{0,2}[kqa-h]{0,2})$"
EP_SHAPE = r"^(-|[a-h][1-8])$"


def expand_placement(placement: Column) -> Column:
    """FEN placement -> 64 chars ('1' per empty square), null when malformed."""
    x = placement
    for n in range(8, 1, -1):
        x = F.replace(x, F.lit(str(n)), F.lit("1" * n))
    ok = placement.rlike(r"^[pnbrqkPNBRQK1-8/]+$") & ~placement.rlike(r"[1-8][1-8]") & x.rlike(BOARD_ROWS)
    return F.when(ok, F.replace(x, F.lit("/"), F.lit("")))


def collapse_board(b: Column) -> Column:
    """64 chars -> FEN placement."""
    x = F.regexp_replace(b, r"(.{8})(?!$)", "$1/")
    for n in range(8, 1, -1):
        x = F.replace(x, F.lit("1" * n), F.lit(str(n)))
    return x


def square_index(name: Column) -> Column:
    """'e2' -> 52."""
    f = F.ascii(F.substring(name, 1, 1)) - 97
    r = F.substring(name, 2, 1).cast("int") - 1
    return (7 - r) * 8 + f


def square_name(idx: Column) -> Column:
    f = idx % 8
    r = 8 - F.floor(idx / 8)
    return F.concat(F.char(f + 97), r.cast("string"))


# ---- SQL text generators (board: a 64-char SQL expression; squares: SQL int indexes) ----

def attacked_sql(b: str, t: str, by_white: bool, v: str = "a") -> str:
    """SQL: is square index ``t`` attacked by the given side on board ``b``?

    One pass over the 64 squares (a higher-order ``exists``): a piece of the
    side attacks ``t`` by its geometry, sliders only through empty squares.
    The lambda form keeps the generated code small; pieces of the other
    side are rejected by the first, cheapest test.  ``v`` names the lambda
    variables (``v``i, ``v``s) so the test nests inside other lambdas.
    """
    i, s_ = f"{v}i", f"{v}s"
    n, bsh, rk, q, k, p = ("N", "B", "R", "Q", "K", "P") if by_white else ("n", "b", "r", "q", "k", "p")
    pawn_dy = 1 if by_white else -1
    pc = f"substr({b}, {i} + 1, 1)"
    dx = f"(({t}) % 8 - {i} % 8)"
    dy = f"({i} div 8 - ({t}) div 8)"
    m = f"greatest(abs({dx}), abs({dy}))"
    step = f"(CAST(signum({dx}) AS INT) - 8 * CAST(signum({dy}) AS INT))"
    clear = f"({m} <= 1 OR forall(sequence(1, {m} - 1), {s_} -> substr({b}, {i} + 1 + {s_} * {step}, 1) = '1'))"
    return (f"exists(sequence(0, 63), {i} -> {i} <> ({t}) AND {pc} IN ('{n}','{bsh}','{rk}','{q}','{k}','{p}') AND ("
            f"({pc} = '{n}' AND abs({dx}) * abs({dy}) = 2) OR "
            f"({pc} = '{k}' AND {m} = 1) OR "
            f"({pc} = '{p}' AND {dy} = {pawn_dy} AND abs({dx}) = 1) OR "
            f"({pc} IN ('{rk}','{q}') AND ({dx} = 0 OR {dy} = 0) AND {clear}) OR "
            f"({pc} IN ('{bsh}','{q}') AND abs({dx}) = abs({dy}) AND {clear})))")


def king_attacked(b: str, white_king: bool) -> Column:
    """Is the king of the given colour attacked on board column ``b``?  False without a king."""
    kch = "K" if white_king else "k"
    return F.expr(f"(instr({b}, '{kch}') > 0 AND {attacked_sql(b, f'(instr({b}, {chr(39)}{kch}{chr(39)}) - 1)', not white_king)})")


def _set(b: Column, idx: Column, ch: Column) -> Column:
    return F.overlay(b, ch, idx + 1, F.lit(1))


def apply_move(df: DataFrame, fen: str, uci: str, out: str = "fen_after") -> DataFrame:
    """P5: the position after ``uci`` is played on ``fen`` (null when the FEN or move is
    malformed or the from-square is empty).

    Follows the push rules of the usual FEN tooling: castling given as the
    king's two-square move or as king-takes-own-rook, en passant, promotion,
    castling rights cleared by king/rook squares and checked against the
    pieces, half-move clock reset by pawn moves and captures, full-move count
    after Black, and an en-passant square written only if a legal en-passant
    capture exists.
    """
    t = "__am_"
    parts = F.split(F.trim(F.col(fen)), r"\s+")
    n_parts = F.size(parts)
    g = df.withColumns({
        f"{t}b": expand_placement(parts.getItem(0)),
        f"{t}side": F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("w")),
        f"{t}cast": F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("-")),
        f"{t}ep": F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("-")),
        f"{t}half": F.coalesce(F.try_element_at(parts, F.lit(5)), F.lit("0")).try_cast("int"),
        f"{t}full": F.coalesce(F.try_element_at(parts, F.lit(6)), F.lit("1")).try_cast("int"),
        f"{t}np": n_parts,
    })
    c = lambda s: F.col(t + s)
    mv = F.col(uci)
    valid = (c("b").isNotNull() & c("side").isin("w", "b") & c("cast").rlike(CASTLING_SHAPE)
             & c("ep").rlike(EP_SHAPE) & (c("half") >= 0) & (c("full") >= 0) & (c("np") <= 6)
             & mv.rlike(UCI_SHAPE) & (F.substring(mv, 1, 2) != F.substring(mv, 3, 2)))
    white = c("side") == "w"
    g = g.withColumns({
        f"{t}ok": valid,
        f"{t}fi": square_index(F.substring(mv, 1, 2)),
        f"{t}ti0": square_index(F.substring(mv, 3, 2)),
        f"{t}pro": F.substring(mv, 5, 1),
    })
    b = c("b")
    piece = F.substring(b, c("fi") + 1, 1)
    ptype = F.lower(piece)
    ff, fr = c("fi") % 8, 7 - F.floor(c("fi") / 8)
    tf0, tr0 = c("ti0") % 8, 7 - F.floor(c("ti0") / 8)
    at = lambda idx: F.substring(b, idx + 1, 1)
    own = lambda ch: F.when(white, ch.rlike("^[PNBRQK]$")).otherwise(ch.rlike("^[pnbrqk]$"))
    # the king's two-square move in the usual notation means king-takes-rook
    std_castle = ((ptype == "k") & c("fi").isin(60, 4) & (tr0 == fr) & tf0.isin(6, 2)
                  & ~F.lower(at(c("ti0"))).eqNullSafe(F.lit("r")) & (ff == 4))
    ti = F.when(std_castle, c("ti0") + F.when(tf0 == 6, 1).otherwise(-2)).otherwise(c("ti0"))
    g = g.withColumns({f"{t}piece": piece, f"{t}ti": ti})
    ti, piece, ptype = c("ti"), c("piece"), F.lower(c("piece"))
    tf, tr = ti % 8, 7 - F.floor(ti / 8)
    target = at(ti)
    castling = (ptype == "k") & own(target)
    diff = (7 - F.floor(ti / 8)) * 8 + tf - (fr * 8 + ff)        # square-number difference (a1 = 0)
    ep_idx = F.when(c("ep") != "-", square_index(c("ep")))
    is_ep = (ptype == "p") & ep_idx.isNotNull() & (ti == ep_idx) & F.abs(diff).isin(7, 9) & (target == "1")
    cap_idx = ep_idx + F.when(white, 8).otherwise(-8)            # the pawn behind the en-passant square
    placed_type = F.when(c("pro") != "", c("pro")).otherwise(ptype)
    placed = F.when(white, F.upper(placed_type)).otherwise(placed_type)
    b1 = _set(b, c("fi"), F.lit("1"))
    b_ep = F.when(is_ep, _set(b1, cap_idx, F.lit("1"))).otherwise(b1)
    rank_base = F.when(white, 56).otherwise(0)                   # index of the a-file square of the home rank
    a_side = tf < ff
    k_idx = rank_base + F.when(a_side, 2).otherwise(6)
    r_idx = rank_base + F.when(a_side, 3).otherwise(5)
    kch, rch = F.when(white, "K").otherwise("k"), F.when(white, "R").otherwise("r")
    b_castle = _set(_set(_set(b1, ti, F.lit("1")), k_idx, kch), r_idx, rch)
    new_b = F.when(castling, b_castle).otherwise(_set(b_ep, ti, placed))
    # castling rights: present in the field, cleaned against the board before and after
    opp = lambda ch: (ch != "1") & ~own(ch)
    zeroing = (ptype == "p") | (F.lower(target) == "p") | opp(piece) | opp(target)
    g = g.withColumns({
        f"{t}nb": new_b,
        f"{t}cap": target,
        f"{t}castling": castling,
        f"{t}zero": zeroing,
        f"{t}dp": (ptype == "p") & (((diff == 16) & (fr == 1)) | ((diff == -16) & (fr == 6))),
    })
    nb = c("nb")

    def right(flags: str, rook_idx: int, king_idx: int, rook: str, king: str, white_side: bool) -> Column:
        had = c("cast").contains(flags[0]) | c("cast").contains(flags[1])
        moved = c("fi").isin(rook_idx) | c("ti").isin(rook_idx)
        king_moved = (F.lower(c("piece")) == "k") & (white if white_side else ~white)
        before_ok = (F.substring(b, rook_idx + 1, 1) == rook) & (F.substring(b, king_idx + 1, 1) == king)
        after_ok = (F.substring(nb, rook_idx + 1, 1) == rook) & (F.substring(nb, king_idx + 1, 1) == king)
        return had & before_ok & ~moved & ~king_moved & after_ok

    rights = F.concat(
        F.when(right("KH", 63, 60, "R", "K", True), "K").otherwise(""),
        F.when(right("QA", 56, 60, "R", "K", True), "Q").otherwise(""),
        F.when(right("kh", 7, 4, "r", "k", False), "k").otherwise(""),
        F.when(right("qa", 0, 4, "r", "k", False), "q").otherwise(""))
    ep_sq = c("fi") + F.when(diff > 0, -8).otherwise(8)          # the square passed over
    g = g.withColumns({
        f"{t}rights": F.when(rights == "", "-").otherwise(rights),
        f"{t}eps": F.when(c("dp"), ep_sq),
        f"{t}nside": F.when(white, "b").otherwise("w"),
    })
    # an en-passant square is written only when the side to move has a legal capture onto it
    eps = c("eps")
    epf = eps % 8
    cap_row = eps + F.when(white, -8).otherwise(8)                # the pushed pawn's square
    their_pawn = F.when(white, "p").otherwise("P")
    for side, dx in (("l", -1), ("r", 1)):
        src = cap_row + dx
        exists = eps.isNotNull() & (epf + dx).between(0, 7) & (F.substring(nb, src + 1, 1) == their_pawn)
        after = _set(_set(_set(nb, src, F.lit("1")), eps, their_pawn), cap_row, F.lit("1"))
        g = g.withColumns({f"{t}x{side}": exists, f"{t}bx{side}": after})
    g = g.withColumns({
        f"{t}lx": c("xl") & ~F.when(white, king_attacked(f"{t}bxl", False)).otherwise(king_attacked(f"{t}bxl", True)),
        f"{t}rx": c("xr") & ~F.when(white, king_attacked(f"{t}bxr", False)).otherwise(king_attacked(f"{t}bxr", True)),
    })
    half = F.when(c("zero"), 0).otherwise(c("half") + 1)
    full = F.greatest(c("full"), F.lit(1)) + F.when(white, 0).otherwise(1)
    ep_text = F.when(c("lx") | c("rx"), square_name(eps)).otherwise("-")
    result = F.concat_ws(" ", collapse_board(nb), c("nside"), c("rights"), ep_text,
                         half.cast("string"), full.cast("string"))
    ok = c("ok") & (c("piece") != "1")
    g = g.withColumn(out, F.when(ok, result))
    return g.drop(*[x for x in g.columns if x.startswith(t)])
