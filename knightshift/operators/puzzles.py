"""Puzzle ingest (P1-P5, P17, J1, W3, W6, L2): filter, validate, position after the
opponent's move, skip stored ids, keep first occurrences, take N, number shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.board import apply_move
from ..functions.columns import py_int
from ..plans.joins import bounded_broadcast
from ..session import cut_lineage
from .ordered import running_totals

ORDER = ["file", "block", "seq"]
PLACE_BITS = 36             # of the packed order: places in a block
STATUSES = ["short_row", "bad_number", "below_rating", "below_popularity", "few_moves", "bad_position", "accepted"]


def split_moves(moves_col: str = "Moves"):
    """Whitespace-split move list, (first move, solution, count)."""
    arr = F.split(F.trim(F.col(moves_col)), r"\s+")
    n = F.when(F.trim(F.col(moves_col)) == "", 0).otherwise(F.size(arr))
    return arr.getItem(0), F.try_element_at(arr, F.lit(2)), n


def screen(raw: DataFrame, min_rating: int, popularity_min: int) -> DataFrame:
    """P1-P4 on dump rows: everything but the board, in the reference order: complete row, integer
    rating / popularity (popularity 100 when the column is absent), thresholds, two moves.

    ``status`` is null for rows that only the board can still reject.
    """
    rating = py_int("Rating")
    pop = py_int("Popularity") if "Popularity" in raw.columns else F.lit(100)
    pop_bad = F.col("Popularity").isNotNull() & pop.isNull() if "Popularity" in raw.columns else F.lit(False)
    first, solution, n_moves = split_moves("Moves")
    themes = F.coalesce(F.col("Themes"), F.lit("")) if "Themes" in raw.columns else F.lit("")
    x = raw.withColumns({"rating": rating, "popularity": pop, "__pop_bad": pop_bad, "__first": first,
                         "solution": solution, "__n_moves": n_moves, "themes": themes})
    status = (F.when(F.col("n_fields") < F.col("n_header"), "short_row")
              .when(F.col("rating").isNull() | F.col("__pop_bad"), "bad_number")
              .when(F.col("rating") < min_rating, "below_rating")
              .when(F.col("popularity") < popularity_min, "below_popularity")
              .when(F.col("__n_moves") < 2, "few_moves"))
    return x.withColumn("status", status)


_OUT = ["solution", "rating", "popularity", "themes"]


def _on_board(screened: DataFrame) -> DataFrame:
    """P5 for the rows that passed the cheap checks: the board after the first move, status accepted or bad_position."""
    x = apply_move(screened.where(F.col("status").isNull()), "FEN", "__first", out="fen")
    status = F.when(F.col("fen").isNull(), "bad_position").otherwise("accepted")
    return x.select(*ORDER, F.col("PuzzleId").alias("puzzle_id"), status.alias("status"), "fen", *_OUT)


def classify_dump(raw: DataFrame, min_rating: int, popularity_min: int, materialize: bool = True) -> DataFrame:
    """P1-P5 on dump rows: a ``status`` per row and, when accepted, the puzzle columns.

    The board is only worked out for rows that pass the cheap checks.  With ``materialize`` these rows are
    written as a table in the shared checkpoint folder: later filters and joins then plan against a plain
    table instead of the board expressions, and a lost executor re-reads it instead of re-parsing the dump.
    """
    screened = screen(raw, min_rating, popularity_min)
    judged = _on_board(screened)
    judged = cut_lineage(judged) if materialize else judged
    refused = screened.where(F.col("status").isNotNull()).select(
        *ORDER, F.col("PuzzleId").alias("puzzle_id"), "status", F.lit(None).cast("string").alias("fen"), *_OUT)
    return refused.unionByName(judged)


def accepted_dump(raw: DataFrame, min_rating: int, popularity_min: int, materialize: bool = True) -> DataFrame:
    """The accepted puzzles of a dump.  Only rows that pass the cheap checks are worked out and written; the
    board's verdict is filtered after the write, so the optimizer never copies the board expressions into a filter."""
    judged = _on_board(screen(raw, min_rating, popularity_min))
    return accepted(cut_lineage(judged) if materialize else judged)


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("status") == "accepted").drop("status")


def reject_counts(classified: DataFrame) -> DataFrame:
    """Rows per status (the malformed-row report)."""
    return classified.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def packed_order(rows: DataFrame, into: str) -> DataFrame:
    """``rows`` with their stream order (file, block, seq) as one long: number of the block, then place in the block.

    ``rows`` should be a written table.  Blocks are numbered in a table of their own, one row each, that is sent to the rows.
    """
    blocks = rows.groupBy("file", "block").agg(F.min("seq").alias("__first"))
    numbered = blocks.select(F.col("file").alias("__f"), F.col("block").alias("__b"), "__first",
                             F.row_number().over(Window.orderBy("file", "block")).cast("long").alias("__no"))
    joined = rows.join(bounded_broadcast(numbered), (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b")))
    return joined.withColumn(into, F.shiftleft("__no", PLACE_BITS) + F.col("seq") - F.col("__first")).drop("__f", "__b", "__first", "__no")


def dedupe_first(rows: DataFrame, key: str = "puzzle_id") -> DataFrame:
    """The first row of every id in stream order.

    The order is packed into a long, so that the first of each id is a hash aggregation of (id, long), reduced
    map-side, without a sort or a text in it; the winners, one number an id, then pick their rows.
    """
    packed = packed_order(rows, "__order")
    first = packed.groupBy(key).agg(F.min("__order").alias("__order")).select("__order")
    return packed.join(first.hint("shuffle_hash"), "__order", "left_semi").drop("__order")


def new_puzzles(rows: DataFrame, stored_ids: DataFrame, key: str = "puzzle_id") -> DataFrame:
    """Rows whose id is not stored yet (anti join)."""
    return rows.join(stored_ids.select(key).distinct(), key, "left_anti")


def take_total(rows: DataFrame, total: int, order=ORDER) -> DataFrame:
    """L2: the first ``total`` rows in stream order (at least one, as the ingest loop
    always keeps the row that reaches the target), by the balanced numbering of
    ``running_totals``: rows of any target are never merged in one task.
    """
    r = running_totals(rows, [], list(order), row_number="__take")
    return r.where(F.col("__take") <= max(total, 1)).drop("__take")


def assign_shards(rows: DataFrame, shard_size: int, existing_shards: int = 0, order=ORDER) -> DataFrame:
    """Shard number and row-in-shard from the global position in stream order
    (balanced two-pass numbering, no single-task sort)."""
    r = running_totals(rows, [], list(order), row_number="__n")
    return r.withColumns({
        "shard": (F.floor((F.col("__n") - 1) / shard_size) + existing_shards).cast("int"),
        "row_in_shard": ((F.col("__n") - 1) % shard_size).cast("int"),
    }).drop("__n")


def puzzle_id_fallback(rows: DataFrame) -> DataFrame:
    """Ids for rows without a PuzzleId column: ``<shard>_<row in shard>``."""
    fallback = F.concat_ws("_", F.col("shard").cast("string"), F.col("row_in_shard").cast("string"))
    if "puzzle_id" in rows.columns:
        return rows.withColumn("puzzle_id", F.coalesce("puzzle_id", fallback))
    return rows.withColumn("puzzle_id", fallback)


def ingest_puzzles(raw: DataFrame, stored_ids: DataFrame, min_rating: int = 2500, popularity_min: int = 80,
                   total: int = 10000, shard_size: int = 1000, existing_shards: int = 0) -> DataFrame:
    """The fetch job: classify -> accepted -> not stored -> first occurrence -> first N -> shards."""
    ok = accepted_dump(raw, min_rating, popularity_min)
    fresh = dedupe_first(new_puzzles(ok, stored_ids))
    taken = take_total(fresh, total)
    return assign_shards(taken, shard_size, existing_shards)


def prepare_csv(raw: DataFrame, min_rating: int, materialize: bool = True) -> DataFrame:
    """S2 rules: integer rating at or above ``min_rating``, two moves, a valid board;
    no popularity filter; themes and game url default to ''.

    The keep flag is projected next to the new position and filtered after
    the checkpoint, so the optimizer never copies the board expressions into
    a pushed-down filter."""
    rating = py_int("Rating") if "Rating" in raw.columns else F.lit(0)
    first, solution, n_moves = split_moves("Moves")
    x = raw.withColumns({"rating": rating, "__first": first, "solution": solution, "__n": n_moves})
    x = x.where(F.col("rating").isNotNull() & (F.col("rating") >= min_rating) & (F.col("__n") >= 2))
    x = apply_move(x, "FEN", "__first", out="fen")
    keep = F.col("fen").isNotNull()
    cols = [*ORDER, "fen", "solution", "rating",
            F.coalesce(F.col("Themes"), F.lit("")).alias("themes") if "Themes" in raw.columns else F.lit("").alias("themes"),
            F.coalesce(F.col("GameUrl"), F.lit("")).alias("game_url") if "GameUrl" in raw.columns else F.lit("").alias("game_url")]
    if "PuzzleId" in raw.columns:
        cols.insert(len(ORDER), F.col("PuzzleId").alias("puzzle_id"))
    out = x.select(*cols, keep.alias("__keep"))
    if materialize:
        out = cut_lineage(out)
    return out.where(F.col("__keep")).drop("__keep")
