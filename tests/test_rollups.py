"""Rollup operators: agreement without pairs equals the self join; percentiles from
histograms equal PERCENTILE_DISC."""
import random

from pyspark.sql import functions as F

from knightshift.operators import rollups as R


def _evals(spark):
    rnd = random.Random(5)
    engines = ["A", "B", "C", "D", "E"]
    rows = []
    for p in range(400):
        for e in engines:
            if rnd.random() < 0.85:
                rows.append(("r1", f"p{p}", e, rnd.choice(["e2e4", "d2d4", "g1f3"]), rnd.randint(1, 40)))
    return spark.createDataFrame(rows, "run_id string, puzzle_id string, engine string, engine_move string, depth int")


def _self_join(ev):
    a, b = ev.alias("a"), ev.alias("b")
    on = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.puzzle_id") == F.col("b.puzzle_id")) & (F.col("a.engine") < F.col("b.engine"))
    same = F.count_if(F.col("a.engine_move") == F.col("b.engine_move"))
    return sorted(tuple(r) for r in a.join(b, on).groupBy("a.engine", "b.engine").agg(F.count(F.lit(1)), same).collect())


def test_agreement_equals_self_join(spark):
    ev = _evals(spark)
    got = sorted((r.engine_a, r.engine_b, r.positions, r.agreements) for r in R.engine_agreement(ev).collect())
    assert got == _self_join(ev) and len(got) == 10
    twice = spark.createDataFrame([("r", "p", "A", "e2e4", 1), ("r", "p", "B", "e2e4", 1), ("r", "p", "B", "d2d4", 1), ("r", "q", "A", None, 1),
                                   ("r", "q", "B", None, 1)], ev.schema)
    got = [tuple(r) for r in R.engine_agreement(twice).collect()]
    assert [g[:4] for g in got] == _self_join(twice) == [("A", "B", 3, 1)]


def test_agreement_of_many_engines(spark):
    ev = spark.createDataFrame([("r", f"p{p}", f"e{e:03d}", str(p % (e + 1)), 1) for p in range(6) for e in range(90)],
                               "run_id string, puzzle_id string, engine string, engine_move string, depth int")
    assert R.engine_agreement(ev).count() == 90 * 89 // 2


def test_percentiles_equal_percentile_disc(spark):
    ev = _evals(spark)
    got = {r.engine: (r.p25, r.p50, r.p75, r.p90) for r in R.depth_percentiles(ev).collect()}
    exp = ev.groupBy("engine").agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY depth)").alias(f"q{q}")
                                     for q in (0.25, 0.5, 0.75, 0.9)]).collect()
    for r in exp:
        assert got[r.engine] == tuple(r[1:]), r.engine
