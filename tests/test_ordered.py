"""Balanced running totals equal the one-window form, also with a hot group."""
import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knightshift.operators.ordered import running_totals


def test_running_totals_match_window(spark, monkeypatch):
    import knightshift.operators.ordered as O
    monkeypatch.setattr(O, "ROWS_PER_CHUNK", 100)      # force many chunks on small data
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 20)}", i, rnd.randint(0, 1)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, o long, x int")
    got = running_totals(df, ["g"], ["o"], {"s": F.col("x")}, row_number="rn")
    w = Window.partitionBy("g").orderBy("o")
    exp = df.select("g", "o", F.row_number().over(w).alias("rn"),
                    F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    a = sorted(tuple(r) for r in got.select("g", "o", "rn", "s").collect())
    b = sorted(tuple(r) for r in exp.collect())
    assert a == b


def test_fine_slices_number_alike(spark, monkeypatch):
    import knightshift.operators.ordered as O
    monkeypatch.setattr(O, "LEAST_ROWS", 40)
    df = spark.createDataFrame([("hot" if i % 4 else None, i * 7 % 1000) for i in range(1000)], "g string, o long")
    numbered = lambda fine: sorted(tuple(r) for r in running_totals(df, ["g"], ["o"], row_number="rn", fine=fine)
                                   .select(F.coalesce("g", F.lit("")), "o", "rn").collect())
    assert O.with_chunks(df, ["g", "o"], fine=True).select("__chunk").distinct().count() == 8
    assert numbered(True) == numbered(False)


def test_global_numbering(spark, monkeypatch):
    import knightshift.operators.ordered as O
    monkeypatch.setattr(O, "ROWS_PER_CHUNK", 50)
    df = spark.createDataFrame([(i * 7 % 1000,) for i in range(1000)], "o long")
    got = running_totals(df, [], ["o"], row_number="rn")
    assert sorted((r.o, r.rn) for r in got.collect()) == [(i, i + 1) for i in range(1000)]


def test_take_total_any_target(spark, monkeypatch):
    import knightshift.operators.ordered as O
    from knightshift.operators import puzzles as P
    df = spark.createDataFrame([("f", 0, i, f"id{i}") for i in range(500)], "file string, block long, seq long, puzzle_id string")
    for rows_per_chunk in (O.ROWS_PER_CHUNK, 50):
        monkeypatch.setattr(O, "ROWS_PER_CHUNK", rows_per_chunk)
        assert {r.puzzle_id for r in P.take_total(df, 120).collect()} == {f"id{i}" for i in range(120)}


def test_null_group_is_cut_and_input_read_once(spark, monkeypatch):
    """A group of nulls spreads over slices like any other, and the input is evaluated once."""
    import knightshift.operators.ordered as O
    monkeypatch.setattr(O, "ROWS_PER_CHUNK", 100)
    calls = spark.sparkContext.accumulator(0)

    def see(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    df = spark.range(2000).selectExpr("IF(id % 10 = 0, 'e', NULL) AS g", "id AS o").mapInArrow(see, "g string, o long")
    sliced = O.with_chunks(df, ["g", "o"])
    assert calls.value == 2000
    per = {(r.g, r["__chunk"]): r["count"] for r in sliced.groupBy("g", "__chunk").count().collect()}
    assert max(per.values()) <= 400 and sum(1 for g, _ in per if g is None) > 5
    got = sorted((r.o, r.rn) for r in O.running_totals(df, ["g"], ["o"]).where("g is null").collect())
    assert [rn for _, rn in got] == list(range(1, 1801))


def test_running_totals_range_chunks(spark, monkeypatch):
    """Many chunks: the range partitioner assigns them and the assignment is stored."""
    import knightshift.operators.ordered as O
    monkeypatch.setattr(O, "ROWS_PER_CHUNK", 20)
    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.5 else f"g{rnd.randint(0, 5)}", i, rnd.randint(0, 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, x int")
    got = running_totals(df, ["g"], ["o"], {"s": F.col("x")}, row_number="rn")
    w = Window.partitionBy("g").orderBy("o")
    exp = df.select("g", "o", F.row_number().over(w).alias("rn"),
                    F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    assert sorted(tuple(r) for r in got.select("g", "o", "rn", "s").collect()) == sorted(tuple(r) for r in exp.collect())
