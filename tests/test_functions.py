"""Scalar rules: comment telemetry, names, families, Python-exact formatting."""
import random

import pytest
from pyspark.sql import functions as F

from knightshift.functions import columns as C

# comment goldens (FIXTURES §1.6)
COMMENTS = [
    ("+0.86/16 0.49s", 0.86, 16, 0.49),
    ("-0.78/10 0.65s, Draw by 3-fold repetition", -0.78, 10, 0.65),
    ("#+3/25 1.8s", 3.0, 25, 1.8),
    ("+M12/25 0.1s", 12.0, 25, 0.1),
    ("-M4/9 2s", 4.0, 9, 2.0),
    ("12/16s", 12.0, 16, 16.0),
    ("book", None, None, None),
    ("mate", None, None, None),
    ("", None, None, None),
]


def test_parse_comment(spark):
    df = spark.createDataFrame([(c,) for c, *_ in COMMENTS], "c string")
    got = df.select(C.parse_comment("c").alias("t")).select("t.*").collect()
    for (c, ev, dp, sec), r in zip(COMMENTS, got):
        assert (r["eval"], r["depth"], r["seconds"]) == (ev, dp, sec), c


def test_names_and_families(spark):
    df = spark.createDataFrame([("Lc0 v0.32.1",), ("Stockfish 18",), ("Leela Zero",), ("Pawnocchio 2.0.1",),
                                ("Reckless 0.9.0",), ("Komodo",)], "n string")
    got = df.select(C.safe_name("n").alias("id"), C.engine_family("n").alias("f")).collect()
    assert [r.id for r in got] == ["lc0_v0_32_1", "stockfish_18", "leela_zero", "pawnocchio_2_0_1",
                                   "reckless_0_9_0", "komodo"]
    assert [r.f for r in got] == ["lc0", "stockfish", "lc0", "pawnocchio", "reckless", "other"]


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_fixed_matches_python(spark, digits):
    rnd = random.Random(digits)
    vals = [0.125, 0.375, 16.25, 0.15, 1.005, 2.675, 0.0, -0.125, 2.5, 3.5, 0.1125, 1.05, 50.5] + \
           [rnd.randint(0, 10 ** 6) / rnd.choice([4, 8, 16, 20, 40, 1000, 3, 7]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for r in df.select("x", C.fixed("x", digits).alias("s")).collect():
        assert r.s == f"{r.x:.{digits}f}"


def test_live_view_is_a_query_with_all_bands(spark):
    from knightshift.operators.telemetry import live_view
    from knightshift.plans.catalog import QUERIES
    assert "live_view" in QUERIES
    df = spark.createDataFrame([(98.0, 18817059.0), (97.99, 56616.0), (90.0, 950.0), (89.99, None)], "running_accuracy_pct double, nps double")
    got = [tuple(r) for r in live_view(df).select("band", "speed", "accuracy_text").collect()]
    assert got == [("high", "18.8M", "98.0"), ("medium", "57k", "98.0"), ("medium", "950", "90.0"), ("low", None, "90.0")]


def test_speed_label(spark):
    vals = [18817059.0, 56616.0, 950.0, 50500.0, 1050000.0]
    df = spark.createDataFrame([(v,) for v in vals], "n double")
    got = [r[0] for r in df.select(C.speed_label("n")).collect()]
    py = [f"{v / 1e6:.1f}M" if v >= 1e6 else (f"{v / 1e3:.0f}k" if v >= 1e3 else f"{v:.0f}") for v in vals]
    assert got == py


def test_points_and_turn(spark):
    df = spark.createDataFrame([("1-0", "8/8/8/8/8/8/8/4K2k b - - 0 1"), ("0-1", None), ("1/2-1/2", "bad fen b"),
                                ("*", "8/8/8/8/8/8/8/4K2k w - - 0 1")], "r string, f string")
    got = df.select(C.white_points("r").alias("w"), C.black_points("r").alias("b"),
                    C.first_turn(F.coalesce("f", F.lit(""))).alias("t")).collect()
    assert [(g.w, g.b) for g in got] == [(1.0, 0.0), (0.0, 1.0), (0.5, 0.5), (None, None)]
    assert [g.t for g in got] == ["b", "w", "w", "w"]


def test_round_half_away_matches_sql_engine(spark):
    import duckdb
    rnd = random.Random(11)
    vals = [0.285, 1.005, 2.675, 0.125, -0.125, 2.5, -2.5, 16.25, 0.0] + \
           [rnd.randint(-10 ** 6, 10 ** 6) / rnd.choice([8, 16, 40, 200, 1000, 3, 7]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    con = duckdb.connect()
    for d in (0, 1, 2, 3):
        got = [r[0] for r in df.select(C.round_half_away("x", d)).collect()]
        exp = [con.execute(f"SELECT round(CAST(? AS DOUBLE), {d})", [v]).fetchone()[0] for v in vals]
        assert got == exp, d


def test_cluster_conf_bounds():
    from knightshift.session import cluster_conf
    big = cluster_conf(100 * 1024 ** 4, 8000)
    small = cluster_conf(1024 ** 3, 64)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 4096       # 256 MB a partition
    assert int(small["spark.sql.shuffle.partitions"]) == 2 * 64          # at least two waves
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_py_int(spark):
    vals = ["12", " 12 ", "+12", "-3", "1_000", "1__0", "_1", "12.5", "x", "", "99999999999"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    got = [r[0] for r in df.select(C.py_int("t")).collect()]

    def py(v):
        try:
            n = int(v)
            return n if -2 ** 31 <= n < 2 ** 31 else None
        except ValueError:
            return None
    assert got == [py(v) for v in vals]


def test_marks_of_a_comment_hold_its_values(spark):
    """The two passes over a move's comment give what ``parse_comment`` gives; neither pattern is in the second half."""
    texts = ["+0.86/16 0.49s", "#-3/9 1.s", "+M9/9 1.5s", "", "book", "1.2/", "/4", "+1./3", "9/99999999999 2s", "-.5/7 x 0.1s/8", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    marks = df.select("c", F.struct(*C.comment_marks("c")).alias("m"))
    got = marks.select("c", F.struct(*C.marked_values(F.col("m.found"), F.col("m.took"))).alias("t"))
    assert got.collect() == df.select("c", C.parse_comment("c").alias("t")).collect()
    second = str(F.struct(*C.marked_values(F.col("found"), F.col("took"))))
    assert "regexp" not in second
