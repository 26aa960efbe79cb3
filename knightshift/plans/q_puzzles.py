"""Registered queries: puzzle dump / CSV ingest, board transitions, shards
(S1-S4, S11, P1-P5, P17, J1, W3, W6, L2, K1).

The raw dump is derived from ``part`` (one line per part, a deterministic
share of malformed lines keyed by ``p_size``) and written as text; the
Spark side reads it back and runs the ingest operators, the oracle derives
the same statuses from the columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.board import apply_move
from ..operators import puzzles as P
from ..session import landed, scratch_path
from ..sinks import files as K
from ..sources import puzzles as SRC
from . import fixtures as fx
from .registry import query

MIN_RATING, POP_MIN, STORED_RATING = 1500, 0, 2500
SHARD, EXISTING_SHARDS, TOTAL = 50, 3, 300
HEADER = ",".join(SRC.CSV_COLUMNS)

# Deterministic malformations by p_size: 1 non-integer rating, 2 short line,
# 3 single move, 4 bad FEN, 5 bad UCI, 6 duplicate id (id of the previous part).
RAW_SQL = """raw AS (
  SELECT p.p_partkey AS pos, p.p_size AS sz,
         CASE WHEN p.p_size = 6 THEN 'p' || CAST(p.p_partkey - 1 AS VARCHAR) ELSE 'p' || CAST(p.p_partkey AS VARCHAR) END AS puzzle_id,
         f.fen_after, f.solution,
         CAST(800 + (p.p_partkey * 37) % 2300 AS INT) AS rating,
         CAST((p.p_partkey * 13) % 201 - 100 AS INT) AS popularity, p.p_name AS themes
  FROM part p JOIN fx_positions f ON f.k = p.p_partkey % 8),
cls AS (
  SELECT *, CASE WHEN sz = 2 THEN 'short_row' WHEN sz = 1 THEN 'bad_number'
                 WHEN rating < 1500 THEN 'below_rating' WHEN popularity < 0 THEN 'below_popularity'
                 WHEN sz = 3 THEN 'few_moves' WHEN sz IN (4, 5) THEN 'bad_position' ELSE 'accepted' END AS status
  FROM raw),
ok AS (SELECT * FROM cls WHERE status = 'accepted'),
stored AS (SELECT DISTINCT puzzle_id FROM ok WHERE rating >= 2500),
fresh AS (SELECT * FROM ok WHERE puzzle_id NOT IN (SELECT puzzle_id FROM stored)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id ORDER BY pos) AS k FROM fresh) t WHERE k = 1)"""


def _dump_lines(spark, d):
    part = fx.table(spark, d, "part")
    pos = F.element_at(fx._literal_rows(fx.POSITIONS, fx.POSITION_COLS), (F.col("p_partkey") % 8 + 1).cast("int"))
    p = part.select("p_partkey", "p_size", "p_name", pos.alias("f"))
    sz, key = F.col("p_size"), F.col("p_partkey")
    pid = F.concat(F.lit("p"), F.when(sz == 6, key - 1).otherwise(key).cast("string"))
    fen = F.when(sz == 4, F.lit("not a fen")).otherwise(F.col("f.fen_before"))
    moves = (F.when(sz == 3, F.col("f.first_move"))
             .when(sz == 5, F.concat(F.lit("z9z9 "), F.col("f.solution")))
             .otherwise(F.concat_ws(" ", "f.first_move", "f.solution")))
    rating = F.when(sz == 1, F.lit("unrated")).otherwise((F.lit(800) + (key * 37) % 2300).cast("string"))
    fields = [pid, fen, moves, rating, (sz + 75).cast("string"), ((key * 13) % 201 - 100).cast("string"),
              (sz * 10).cast("string"), F.col("p_name"), F.concat(F.lit("https://example.org/"), key.cast("string")),
              F.lit("")]
    line = F.when(sz == 2, F.concat_ws(",", *fields[:4])).otherwise(F.concat_ws(",", *fields))
    return p.select(key.alias("pos"), line.alias("value"), pid.alias("pid"), sz.alias("sz"))


def _write_dump(spark, d, path):
    lines = _dump_lines(spark, d).select("pos", "value")
    head = spark.createDataFrame([(-1, HEADER)], "pos long, value string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (head.unionByName(lines).repartitionByRange(n, "pos").sortWithinPartitions("pos")
     .select("value").write.mode("overwrite").text(path))


def _dump_path(spark, d):
    return landed(spark, f"dump:{d}", lambda path: _write_dump(spark, d, path))


def _classified(spark, d):
    return P.classify_dump(SRC.read_puzzle_dump(spark, _dump_path(spark, d)), MIN_RATING, POP_MIN)


@query("src_puzzles_raw", f"WITH {RAW_SQL} SELECT puzzle_id, status, CASE WHEN status = 'accepted' THEN fen_after END AS fen FROM cls")
def q_src_puzzles_raw(spark, d):
    c = _classified(spark, d)
    return c.select("puzzle_id", "status", F.when(F.col("status") == "accepted", F.col("fen")).alias("fen"))


@query("reject_malformed", f"WITH {RAW_SQL} SELECT status, COUNT(*) AS rows FROM cls GROUP BY status")
def q_reject_malformed(spark, d):
    return P.reject_counts(_classified(spark, d))


@query("new_puzzles", f"WITH {RAW_SQL} SELECT puzzle_id, rating FROM fresh")
def q_new_puzzles(spark, d):
    ok = P.accepted(_classified(spark, d))
    stored = ok.where(F.col("rating") >= STORED_RATING).select("puzzle_id")
    return P.new_puzzles(ok, stored).select("puzzle_id", "rating")


@query("dedupe_first", f"WITH {RAW_SQL} SELECT puzzle_id, fen_after AS fen, rating FROM firsts")
def q_dedupe_first(spark, d):
    ok = P.accepted(_classified(spark, d))
    stored = ok.where(F.col("rating") >= STORED_RATING).select("puzzle_id")
    return P.dedupe_first(P.new_puzzles(ok, stored)).select("puzzle_id", "fen", "rating")


@query("take_total", f"WITH {RAW_SQL} SELECT puzzle_id, rating FROM firsts ORDER BY pos LIMIT {TOTAL}")
def q_take_total(spark, d):
    ok = P.accepted(_classified(spark, d))
    stored = ok.where(F.col("rating") >= STORED_RATING).select("puzzle_id")
    return P.take_total(P.dedupe_first(P.new_puzzles(ok, stored)), TOTAL).select("puzzle_id", "rating")


@query("assign_shards", f"""WITH {RAW_SQL}
SELECT puzzle_id, CAST(floor((n - 1) / {SHARD}) + {EXISTING_SHARDS} AS INTEGER) AS shard,
       CAST((n - 1) % {SHARD} AS INTEGER) AS row_in_shard
FROM (SELECT puzzle_id, row_number() OVER (ORDER BY pos) AS n FROM firsts) t""")
def q_assign_shards(spark, d):
    ok = P.accepted(_classified(spark, d))
    stored = ok.where(F.col("rating") >= STORED_RATING).select("puzzle_id")
    fresh = P.dedupe_first(P.new_puzzles(ok, stored))
    return P.assign_shards(fresh, SHARD, EXISTING_SHARDS).select("puzzle_id", "shard", "row_in_shard")


@query("write_shards", f"""WITH {RAW_SQL}
SELECT CAST(floor((n - 1) / {SHARD}) + {EXISTING_SHARDS} AS INTEGER) AS shard, COUNT(*) AS rows
FROM (SELECT row_number() OVER (ORDER BY pos) AS n FROM firsts) t GROUP BY 1""")
def q_write_shards(spark, d):
    raw = SRC.read_puzzle_dump(spark, _dump_path(spark, d))
    ok = P.accepted_dump(raw, MIN_RATING, POP_MIN)
    seen = ok.where(F.col("rating") >= STORED_RATING)
    path = scratch_path(spark, "shards")
    columns = ["puzzle_id", "fen", "solution", "rating", "popularity", "themes", "shard"]
    # the store holds shards 0..2 already (their rows are the stored ids); the next number is read from it
    K.write_shards(seen.withColumn("shard", F.pmod(F.xxhash64("puzzle_id"), F.lit(EXISTING_SHARDS)).cast("int")).select(*columns)
                   .unionByName(seen.limit(EXISTING_SHARDS).withColumn("shard", F.lit(EXISTING_SHARDS - 1)).select(*columns)),
                   path, SHARD, numbered=True)
    first = K.next_shard(spark, path)
    stored = SRC.existing_ids(spark, path)
    K.write_shards(P.assign_shards(P.dedupe_first(P.new_puzzles(ok, stored)), SHARD, first).select(*columns), path, SHARD, numbered=True)
    return SRC.read_shards(spark, path).where(F.col("shard") >= first).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


@query("src_shards", f"""WITH {RAW_SQL}
SELECT puzzle_id, CAST(floor((n - 1) / {SHARD}) AS INTEGER) AS shard FROM (SELECT puzzle_id, row_number() OVER (ORDER BY pos) AS n FROM firsts) t""")
def q_src_shards(spark, d):
    ok = P.accepted(_classified(spark, d))
    stored = ok.where(F.col("rating") >= STORED_RATING).select("puzzle_id")
    shards = P.assign_shards(P.dedupe_first(P.new_puzzles(ok, stored)), SHARD, 0)
    path = scratch_path(spark, "shards")
    K.write_shards(shards.select("puzzle_id", "fen", "solution", "rating", "popularity", "themes", "shard"),
                   path, SHARD, numbered=True)
    return SRC.read_shards(spark, path).select("puzzle_id", "shard")


@query("src_existing_ids", f"WITH {RAW_SQL} SELECT DISTINCT puzzle_id FROM ok")
def q_src_existing_ids(spark, d):
    ok = P.accepted(_classified(spark, d))
    path = scratch_path(spark, "store")
    K.write_shards(ok.select("puzzle_id", "fen", "solution", "rating", "popularity", "themes"), path, SHARD)
    # a damaged file in the store is skipped, as the reference skips unreadable shards
    spark.createDataFrame([("not parquet",)], "value string").write.mode("append").text(path)
    return SRC.existing_ids(spark, path).distinct()


@query("src_puzzles_csv", """
SELECT 'p' || CAST(p.p_partkey AS VARCHAR) AS puzzle_id, f.fen_after AS fen, f.solution,
       CAST(800 + (p.p_partkey * 37) % 2300 AS INT) AS rating, p.p_name AS themes,
       'https://example.org/' || CAST(p.p_partkey AS VARCHAR) AS game_url
FROM part p JOIN fx_positions f ON f.k = p.p_partkey % 8
WHERE 800 + (p.p_partkey * 37) % 2300 >= 1500""")
def q_src_puzzles_csv(spark, d):
    def write(path):
        z = fx.fx_puzzles(spark, d)
        (z.select(F.col("puzzle_id").alias("PuzzleId"), F.col("fen_before").alias("FEN"), F.col("moves").alias("Moves"),
                  F.col("rating").cast("string").alias("Rating"), F.col("themes").alias("Themes"),
                  F.col("game_url").alias("GameUrl"))
         .write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path))
    path = landed(spark, f"csv:{d}", write)
    rows = P.prepare_csv(SRC.read_puzzle_csv(spark, path), MIN_RATING)
    return rows.select("puzzle_id", "fen", "solution", "rating", "themes", "game_url")


@query("puzzle_id_fallback", f"""
SELECT CAST(CAST(floor((n - 1) / {SHARD}) AS BIGINT) AS VARCHAR) || '_' || CAST((n - 1) % {SHARD} AS VARCHAR) AS puzzle_id, rating
FROM (SELECT CAST(800 + (p_partkey * 37) % 2300 AS INT) AS rating,
             row_number() OVER (ORDER BY p_partkey) AS n
      FROM part WHERE 800 + (p_partkey * 37) % 2300 >= 1500) t""")
def q_puzzle_id_fallback(spark, d):
    def write(path):
        z = fx.fx_puzzles(spark, d)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (z.repartitionByRange(n, "pos").sortWithinPartitions("pos")
         .select(F.col("fen_before").alias("FEN"), F.col("moves").alias("Moves"),
                 F.col("rating").cast("string").alias("Rating"))
         .write.mode("overwrite").option("header", True).csv(path))
    path = landed(spark, f"csv_noid:{d}", write)
    rows = P.prepare_csv(SRC.read_puzzle_csv(spark, path), MIN_RATING)
    return P.puzzle_id_fallback(P.assign_shards(rows, SHARD, 0)).select("puzzle_id", "rating")


@query("filter_rating", "SELECT puzzle_id, rating FROM fx_puzzles WHERE rating >= 2000")
def q_filter_rating(spark, d):
    return fx.fx_puzzles(spark, d).where(F.col("rating") >= 2000).select("puzzle_id", "rating")


@query("filter_popularity", "SELECT puzzle_id, popularity FROM fx_puzzles WHERE popularity >= 80")
def q_filter_popularity(spark, d):
    return fx.fx_puzzles(spark, d).where(F.col("popularity") >= 80).select("puzzle_id", "popularity")


@query("split_moves", """
SELECT puzzle_id, split_part(moves, ' ', 1) AS first_move, split_part(moves, ' ', 2) AS solution,
       CAST(len(string_split(moves, ' ')) AS INTEGER) AS n_moves FROM fx_puzzles""")
def q_split_moves(spark, d):
    z = fx.fx_puzzles(spark, d)
    first, sol, n = P.split_moves("moves")
    return z.select("puzzle_id", first.alias("first_move"), sol.alias("solution"), n.alias("n_moves"))


@query("apply_move", "SELECT puzzle_id, fen FROM fx_puzzles")
def q_apply_move(spark, d):
    z = fx.fx_puzzles(spark, d).select("puzzle_id", "fen_before", F.split("moves", " ").getItem(0).alias("m"))
    return apply_move(z, "fen_before", "m", out="fen").select("puzzle_id", "fen")


@query("puzzle_lookup", """
SELECT puzzle_id, rating FROM fx_puzzles
WHERE puzzle_id = 'p42' OR DATE '2026-01-01' + CAST(pos AS INTEGER) = DATE '2026-03-01'""")
def q_puzzle_lookup(spark, d):
    from ..sources.puzzles import puzzle_lookup
    z = fx.fx_puzzles(spark, d).withColumn("daily_date", F.date_add(F.lit("2026-01-01").cast("date"), F.col("pos").cast("int")))
    return puzzle_lookup(z, puzzle_id="p42", date="2026-03-01").select("puzzle_id", "rating")
