"""Standard algebraic notation of a UCI move, as native column expressions.

``annotate_san(df, fen, uci)`` gives e.g. 'e4', 'Nxd6', 'Rad1', 'fxe3',
'a8=Q', 'O-O', 'Rb8#'; a move that does not parse or is not legal in the
position comes back unchanged (the reference's rule).  Legality (own king not
left in check, castling through unattacked squares), disambiguation among
same-type pieces that can legally reach the target, and the check / mate
suffix are computed with higher-order functions over the 64-square board
string of :mod:`.board`; the mate test (does the side in check have any
legal reply?) runs only for moves that give check.

Distinct (fen, move) pairs are annotated once and joined back, because the
same puzzle position is answered by every engine in every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import bounded_broadcast
from ..session import cut_lineage
from .board import CASTLING_SHAPE, EP_SHAPE, UCI_SHAPE, attacked_sql, expand_placement


WHITE_SET = "('P','N','B','R','Q','K')"
BLACK_SET = "('p','n','b','r','q','k')"


def _own(ch: str, white: bool) -> str:
    return f"({ch} IN {WHITE_SET if white else BLACK_SET})"


def _pc(b: str, i: str) -> str:
    return f"substr({b}, ({i}) + 1, 1)"


def _dx(a: str, t: str) -> str:
    return f"(({t}) % 8 - ({a}) % 8)"


def _dy(a: str, t: str) -> str:
    return f"(({a}) div 8 - ({t}) div 8)"


def _clear(b: str, a: str, t: str, v: str) -> str:
    dx, dy = _dx(a, t), _dy(a, t)
    m = f"greatest(abs({dx}), abs({dy}))"
    step = f"(CAST(signum({dx}) AS INT) - 8 * CAST(signum({dy}) AS INT))"
    return f"({m} <= 1 OR forall(sequence(1, {m} - 1), {v} -> substr({b}, ({a}) + 1 + {v} * {step}, 1) = '1'))"


def _geometry(b: str, a: str, t: str, white: bool, ep: str, v: str) -> str:
    """Pseudo-legal movement of the piece on ``a`` to ``t`` (castling excluded)."""
    dx, dy = _dx(a, t), _dy(a, t)
    m = f"greatest(abs({dx}), abs({dy}))"
    d, start, ep_rank = (1, 1, 4) if white else (-1, 6, 3)
    tgt = _pc(b, t)
    rank_a = f"(7 - ({a}) div 8)"
    mid = f"(({a}) - {8 * d})"
    pawn = (f"(({dx} = 0 AND {dy} = {d} AND {tgt} = '1') OR "
            f"({dx} = 0 AND {dy} = {2 * d} AND {rank_a} = {start} AND {tgt} = '1' AND {_pc(b, mid)} = '1') OR "
            f"(abs({dx}) = 1 AND {dy} = {d} AND {_own(tgt, not white)}) OR "
            f"(abs({dx}) = 1 AND {dy} = {d} AND ({t}) = ({ep}) AND {tgt} = '1' AND {rank_a} = {ep_rank}))")
    clear = _clear(b, a, t, v)
    return (f"(CASE lower({_pc(b, a)}) WHEN 'n' THEN abs({dx}) * abs({dy}) = 2 WHEN 'k' THEN {m} = 1 "
            f"WHEN 'r' THEN ({dx} = 0 OR {dy} = 0) AND {clear} "
            f"WHEN 'b' THEN abs({dx}) = abs({dy}) AND {clear} "
            f"WHEN 'q' THEN ({dx} = 0 OR {dy} = 0 OR abs({dx}) = abs({dy})) AND {clear} "
            f"WHEN 'p' THEN {pawn} ELSE false END)")


def _after(b: str, a: str, t: str, white: bool, ep: str) -> str:
    """Board after a plain move (en-passant victim removed); promotion piece irrelevant here."""
    moved = _pc(b, a)
    b1 = f"overlay(overlay({b} PLACING '1' FROM ({a}) + 1 FOR 1) PLACING {moved} FROM ({t}) + 1 FOR 1)"
    is_ep = f"(lower({moved}) = 'p' AND ({t}) = ({ep}) AND abs({_dx(a, t)}) = 1 AND {_pc(b, t)} = '1')"
    cap = f"(({t}) + {8 if white else -8})"
    return f"(CASE WHEN {is_ep} THEN overlay({b1} PLACING '1' FROM {cap} + 1 FOR 1) ELSE {b1} END)"


def _safe_after(b: str, a: str, t: str, white: bool, ep: str, v: str) -> str:
    """Own king not attacked after the plain move (the new board is bound once by a lambda)."""
    k = "K" if white else "k"
    nb = f"{v}b"
    ksq = f"(CASE WHEN {_pc(b, a)} = '{k}' THEN ({t}) ELSE instr({nb}, '{k}') - 1 END)"
    body = f"(instr({nb}, '{k}') = 0 OR NOT {attacked_sql(nb, ksq, not white, v)})"
    return f"element_at(transform(array({_after(b, a, t, white, ep)}), {nb} -> {body}), 1)"


def _legal(b: str, a: str, t: str, white: bool, ep: str, v: str) -> str:
    return (f"({_own(_pc(b, a), white)} AND NOT {_own(_pc(b, t), white)} AND "
            f"{_geometry(b, a, t, white, ep, v + 'g')} AND {_safe_after(b, a, t, white, ep, v + 'k')})")


def _has_reply(b: str, white: bool, ep: str) -> str:
    """Does ``white`` (True/False side) have any legal non-castling move on board ``b``?"""
    return (f"exists(sequence(0, 63), rp -> {_own(_pc(b, 'rp'), white)} AND "
            f"exists(sequence(0, 63), rq -> {_legal(b, 'rp', 'rq', white, ep, 'r')}))")


def annotate_san_columns(df: DataFrame, fen: str, moves: dict[str, str]) -> DataFrame:
    """SAN for several move columns of the same position in one pass: the distinct
    (fen, move) pairs of all columns are annotated together, then joined back per column."""
    pairs = None
    for uci in moves:
        p = df.select(F.col(fen).alias("__fen"), F.col(uci).alias("__uci"))
        pairs = p if pairs is None else pairs.union(p)
    ann = bounded_broadcast(cut_lineage(_annotate(pairs.distinct(), "__fen", "__uci", "__san")))
    out = df
    for uci, name in moves.items():
        a = ann.select(F.col("__fen").alias(f"__f_{name}"), F.col("__uci").alias(f"__u_{name}"),
                       F.col("__san").alias(name))
        cond = [out[fen].eqNullSafe(a[f"__f_{name}"]), out[uci].eqNullSafe(a[f"__u_{name}"])]
        out = out.join(a, cond, "left").drop(f"__f_{name}", f"__u_{name}")
    return out


def annotate_san(df: DataFrame, fen: str, uci: str, out: str = "san", dedupe: bool = True) -> DataFrame:
    """Adds ``out``: SAN of ``uci`` in ``fen``, or ``uci`` itself when not a legal move."""
    if dedupe:
        pairs = df.select(F.col(fen).alias("__fen"), F.col(uci).alias("__uci")).distinct()
        # the annotated pairs are a derived table: written once to the shared folder,
        # broadcast back when their count is within the bound, else joined by shuffle
        ann = bounded_broadcast(cut_lineage(_annotate(pairs, "__fen", "__uci", "__san")))
        cond = [df[fen].eqNullSafe(ann["__fen"]), df[uci].eqNullSafe(ann["__uci"])]
        return df.join(ann, cond, "left").select(*[df[c] for c in df.columns], F.col("__san").alias(out))
    return _annotate(df, fen, uci, out)


def _annotate(df: DataFrame, fen: str, uci: str, out: str) -> DataFrame:
    t = "__sn_"
    parts = F.split(F.trim(F.col(fen)), r"\s+")
    mv = F.col(uci)
    g = df.withColumns({
        f"{t}b": expand_placement(parts.getItem(0)),
        f"{t}side": F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("w")),
        f"{t}cast": F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("-")),
        f"{t}eps": F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("-")),
        f"{t}np": F.size(parts),
        f"{t}hm": F.coalesce(F.try_element_at(parts, F.lit(5)), F.lit("0")).try_cast("int"),
        f"{t}fm": F.coalesce(F.try_element_at(parts, F.lit(6)), F.lit("1")).try_cast("int"),
    })
    c = lambda s: F.col(t + s)
    ok = (c("b").isNotNull() & c("side").isin("w", "b") & c("cast").rlike(CASTLING_SHAPE) & c("eps").rlike(EP_SHAPE)
          & (c("np") <= 6) & (c("hm") >= 0) & (c("fm") >= 0)
          & F.coalesce(mv.rlike(UCI_SHAPE), F.lit(False)) & (F.substring(mv, 1, 2) != F.substring(mv, 3, 2)))
    sq = lambda s: (F.lit(7) - (F.substring(s, 2, 1).cast("int") - 1)) * 8 + (F.ascii(F.substring(s, 1, 1)) - 97)
    g = g.withColumns({
        f"{t}ok": ok,
        f"{t}a": F.when(ok, sq(F.substring(mv, 1, 2))),
        f"{t}z": F.when(ok, sq(F.substring(mv, 3, 2))),
        f"{t}pro": F.substring(mv, 5, 1),
        f"{t}ep": F.when(c("eps") != "-", sq(c("eps"))).otherwise(F.lit(-1)),
    })
    b, a, z, ep = f"{t}b", f"{t}a", f"{t}z", f"{t}ep"

    def side_exprs(white: bool):
        k, r = ("K", "R") if white else ("k", "r")
        base = 56 if white else 0                     # index of the a-file square of the home rank
        home = base + 4
        flags = ("K", "H", "Q", "A") if white else ("k", "h", "q", "a")
        cast = f"{t}cast"
        piece = _pc(b, a)
        king_side = (f"(instr({cast}, '{flags[0]}') > 0 OR instr({cast}, '{flags[1]}') > 0) AND "
                     f"{_pc(b, str(base + 7))} = '{r}' AND {_pc(b, str(base + 5))} = '1' AND {_pc(b, str(base + 6))} = '1'")
        queen_side = (f"(instr({cast}, '{flags[2]}') > 0 OR instr({cast}, '{flags[3]}') > 0) AND "
                      f"{_pc(b, str(base))} = '{r}' AND {_pc(b, str(base + 1))} = '1' AND "
                      f"{_pc(b, str(base + 2))} = '1' AND {_pc(b, str(base + 3))} = '1'")
        att = lambda sqi, v: attacked_sql(b, str(sqi), not white, v)
        castle = (f"({piece} = '{k}' AND ({a}) = {home} AND "
                  f"((({z}) = {home + 2} AND {king_side} AND NOT {att(home, 'c1')} AND NOT {att(home + 1, 'c2')} "
                  f"AND NOT {att(home + 2, 'c3')}) OR "
                  f"(({z}) = {home - 2} AND {queen_side} AND NOT {att(home, 'c4')} AND NOT {att(home - 1, 'c5')} "
                  f"AND NOT {att(home - 2, 'c6')})))")
        last_rank = 0 if white else 7                  # index row of the promotion rank
        to_last = f"(lower({piece}) = 'p' AND ({z}) div 8 = {last_rank})"
        promo_ok = f"(CASE WHEN {to_last} THEN {t}pro IN ('q','r','b','n') ELSE {t}pro = '' END)"
        legal = f"({castle} OR ({promo_ok} AND {_legal(b, a, z, white, ep, 'm')}))"
        return castle, legal

    cw, lw = side_exprs(True)
    cb, lb = side_exprs(False)
    g = g.withColumns({
        f"{t}castle": F.when(c("ok"), F.expr(f"CASE WHEN {t}side = 'w' THEN {cw} ELSE {cb} END")),
        f"{t}legal": F.when(c("ok"), F.expr(f"CASE WHEN {t}side = 'w' THEN {lw} ELSE {lb} END")),
    })
    g = g.withColumn(f"{t}legal", F.coalesce(c("legal"), F.lit(False)))
    white = c("side") == "w"
    piece = F.substring(c("b"), c("a") + 1, 1)
    target = F.substring(c("b"), c("z") + 1, 1)
    ptype = F.lower(piece)
    ff = c("a") % 8
    name = lambda i: F.concat(F.char(i % 8 + 97), (8 - F.floor(i / 8)).cast("string"))
    is_ep = (ptype == "p") & (c("z") == c("ep")) & (target == "1") & (F.abs(c("z") % 8 - ff) == 1)
    capture = ((target != "1") & (F.when(white, target.rlike("^[pnbrqk]$")).otherwise(target.rlike("^[PNBRQK]$")))) | is_ep
    # board after the move (castling moves king and rook)
    plain_after = F.expr(f"CASE WHEN {t}side = 'w' THEN {_after(b, a, z, True, ep)} ELSE {_after(b, a, z, False, ep)} END")
    placed = F.when(c("pro") != "", F.when(white, F.upper(c("pro"))).otherwise(c("pro"))).otherwise(piece)
    plain_after = F.overlay(plain_after, placed, c("z") + 1, F.lit(1))
    ks = c("z") > c("a")
    home_base = F.when(white, 56).otherwise(0)
    kch, rch = F.when(white, "K").otherwise("k"), F.when(white, "R").otherwise("r")
    rook_from = home_base + F.when(ks, 7).otherwise(0)
    castled = F.overlay(F.overlay(F.overlay(F.overlay(c("b"), F.lit("1"), c("a") + 1, F.lit(1)),
                                            F.lit("1"), rook_from + 1, F.lit(1)),
                                  kch, home_base + F.when(ks, 7).otherwise(3), F.lit(1)),
                        rch, home_base + F.when(ks, 6).otherwise(4), F.lit(1))
    double_push = (ptype == "p") & (F.abs(c("z") - c("a")) == 16)
    g = g.withColumns({
        f"{t}nb": F.when(c("legal"), F.when(c("castle"), castled).otherwise(plain_after)),
        f"{t}ep2": F.when(c("legal") & double_push, (c("a") + c("z")) / 2).otherwise(F.lit(-1)).cast("int"),
        f"{t}cap": capture,
    })
    nb, ep2 = f"{t}nb", f"{t}ep2"
    # others: same-type pieces that could legally go to the same square (disambiguation)
    others_w = (f"filter(sequence(0, 63), oo -> oo <> {a} AND {_pc(b, 'oo')} = {_pc(b, a)} AND "
                f"{_legal(b, 'oo', z, True, ep, 'd')})")
    others_b = (f"filter(sequence(0, 63), oo -> oo <> {a} AND {_pc(b, 'oo')} = {_pc(b, a)} AND "
                f"{_legal(b, 'oo', z, False, ep, 'd')})")
    check_w = f"(instr({nb}, 'k') > 0 AND {attacked_sql(nb, f'instr({nb}, {chr(39)}k{chr(39)}) - 1', True, 'h')})"
    check_b = f"(instr({nb}, 'K') > 0 AND {attacked_sql(nb, f'instr({nb}, {chr(39)}K{chr(39)}) - 1', False, 'h')})"
    g = g.withColumns({
        f"{t}others": F.when(c("legal") & ~c("castle") & (ptype != "p"),
                             F.expr(f"CASE WHEN {t}side = 'w' THEN {others_w} ELSE {others_b} END")),
        f"{t}check": F.when(c("legal"), F.expr(f"CASE WHEN {t}side = 'w' THEN {check_w} ELSE {check_b} END")),
    })
    g = g.withColumn(f"{t}mate", F.when(
        c("check"), F.expr(f"NOT (CASE WHEN {t}side = 'w' THEN {_has_reply(nb, False, ep2)} "
                           f"ELSE {_has_reply(nb, True, ep2)} END)")).otherwise(F.lit(False)))
    others = c("others")
    has_others = F.coalesce(F.size(others), F.lit(0)) > 0
    same_rank = F.exists(others, lambda o: F.floor(o / 8) == F.floor(c("a") / 8))
    same_file = F.exists(others, lambda o: o % 8 == ff)
    disamb = F.concat(
        F.when(has_others & (same_rank | ~same_file), F.char(ff + 97)).otherwise(""),
        F.when(has_others & same_file, (8 - F.floor(c("a") / 8)).cast("string")).otherwise(""))
    pawn_san = F.concat(F.when(c("cap"), F.concat(F.char(ff + 97), F.lit("x"))).otherwise(""), name(c("z")),
                        F.when(c("pro") != "", F.concat(F.lit("="), F.upper(c("pro")))).otherwise(""))
    piece_san = F.concat(F.upper(ptype), disamb, F.when(c("cap"), "x").otherwise(""), name(c("z")))
    body = (F.when(c("castle"), F.when(ks, "O-O").otherwise("O-O-O"))
            .when(ptype == "p", pawn_san).otherwise(piece_san))
    suffix = F.when(c("mate"), "#").when(c("check"), "+").otherwise("")
    san = F.when(c("legal"), F.concat(body, suffix)).otherwise(mv)
    g = g.withColumn(out, san)
    return g.drop(*[x for x in g.columns if x.startswith(t)])
