"""Evaluation rollups (A1-A5, A14) and the joins that feed them.

Every rollup is a plain GROUP BY with partial (map-side) aggregation: each
task reduces its rows to one row per group before the shuffle, so a hot
engine holding a third of all evaluations costs no more than a cold one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import bool_avg_pct, count_true, round_half_away, safe_name
from ..plans.joins import bounded_broadcast


def _measure(kind: str) -> Column:
    return {
        "count": F.count(F.lit(1)),
        "solved": count_true("is_correct"),
        "accuracy_pct": bool_avg_pct("is_correct", 2),
        "avg_nps": round_half_away(F.avg("nps"), 0),
        "avg_depth": round_half_away(F.avg("depth"), 1),
        "avg_sec": round_half_away(F.avg("elapsed_seconds"), 3),
        "avg_rating": round_half_away(F.avg("rating"), 0),
        "total_sec": round_half_away(F.sum("elapsed_seconds"), 1),
    }[kind]


# measure sets: (output name, measure kind)
ENGINE_ROLLUP = [("total_puzzles", "count"), ("solved", "solved"), ("accuracy_pct", "accuracy_pct"),
                 ("avg_nps", "avg_nps"), ("avg_depth", "avg_depth"), ("avg_sec_per_pos", "avg_sec"),
                 ("avg_puzzle_rating", "avg_rating")]
TELEMETRY_ROLLUP = [("total_puzzles", "count"), ("solved", "solved"), ("accuracy_pct", "accuracy_pct"),
                    ("avg_nps", "avg_nps"), ("avg_depth", "avg_depth"), ("avg_sec", "avg_sec"),
                    ("total_sec", "total_sec")]
EXPORT_ROLLUP = ENGINE_ROLLUP[:-1]                      # default CSV export: 7 columns
EXPORT_ROLLUP_SHORT = [("n", "count"), ("acc_pct", "accuracy_pct"), ("avg_nps", "avg_nps"),
                       ("avg_depth", "avg_depth")]      # documented 5-column variant
EXPORT_ROLLUP_DOC = [("n", "count"), ("solved", "solved"), ("acc_pct", "accuracy_pct"),
                     ("avg_nps", "avg_nps"), ("avg_depth", "avg_depth"), ("avg_sec", "avg_sec")]
MINI_ROLLUP = [("total", "count"), ("accuracy_pct", "accuracy_pct")]


def rollup(evals: DataFrame, by=("engine",), measures=ENGINE_ROLLUP, order: bool = True) -> DataFrame:
    """GROUP BY ``by`` with the named measures; ordered by accuracy then speed like the reports.

    All runs are pooled unless ``run_id`` is part of ``by`` (a puzzle scored in
    two runs counts twice, as in the reference's summary).
    """
    out = evals.groupBy(*by).agg(*[_measure(k).alias(n) for n, k in measures])
    names = [n for n, _ in measures]
    if order:
        acc = "accuracy_pct" if "accuracy_pct" in names else ("acc_pct" if "acc_pct" in names else None)
        keys = ([F.desc(acc)] if acc else []) + ([F.desc("avg_nps")] if "avg_nps" in names else [])
        if keys:
            out = out.orderBy(*keys)
    return out


def engine_rollup(evals: DataFrame, by=("engine",)) -> DataFrame:
    """A1: the consolidated engine summary."""
    return rollup(evals, by, ENGINE_ROLLUP)


def telemetry_rollup(evals: DataFrame, by=("engine",)) -> DataFrame:
    """A2: dashboard rollup (avg and total seconds)."""
    return rollup(evals, by, TELEMETRY_ROLLUP)


def rollup_3nf(evaluations: DataFrame, engines: DataFrame, run_id: str) -> DataFrame:
    """J2 + A4: one run's accuracy per engine display name over the normalized tables."""
    ev = evaluations.where(F.col("run_id") == run_id).select("engine_id", "is_correct")
    eng = bounded_broadcast(engines.select("engine_id", "engine_name"))
    j = ev.join(eng, "engine_id")
    return (j.groupBy("engine_name")
            .agg(F.count(F.lit(1)).alias("total"), count_true("is_correct").alias("solved"),
                 bool_avg_pct("is_correct").alias("accuracy_pct"))
            .orderBy(F.desc("accuracy_pct")))


def theme_bridge(puzzles: DataFrame) -> DataFrame:
    """Themes string -> (puzzle_id, theme_id) rows, one per distinct theme of a puzzle."""
    t = puzzles.select("puzzle_id", F.explode(F.split(F.trim(F.coalesce("themes", F.lit(""))), r"\s+"))
                       .alias("theme_id"))
    return t.where(F.col("theme_id") != "").distinct()


def accuracy_by_theme(evals: DataFrame, puzzles: DataFrame) -> DataFrame:
    """Accuracy per theme.  Evaluations are first reduced to one row per
    puzzle (partial aggregation), then joined to the bridge on the same key."""
    per_puzzle = (evals.groupBy("puzzle_id")
                  .agg(F.count(F.lit(1)).alias("n"), count_true("is_correct").alias("s")))
    j = per_puzzle.join(theme_bridge(puzzles), "puzzle_id")
    return (j.groupBy("theme_id")
            .agg(F.sum("n").alias("evaluations"), F.sum("s").alias("solved"),
                 round_half_away(F.sum("s").cast("double") * 100.0 / F.sum("n").cast("double"), 2).alias("accuracy_pct")))


def rollup_by_movetime(evals: DataFrame, runs: DataFrame) -> DataFrame:
    """Accuracy per engine and nominal movetime of the run."""
    r = bounded_broadcast(runs.select("run_id", "movetime_ms"))
    j = evals.select("run_id", "engine", "is_correct", "elapsed_seconds").join(r, "run_id")
    return (j.groupBy("engine", "movetime_ms")
            .agg(F.count(F.lit(1)).alias("total"), count_true("is_correct").alias("solved"),
                 bool_avg_pct("is_correct").alias("accuracy_pct"),
                 round_half_away(F.avg("elapsed_seconds"), 3).alias("avg_sec")))


def engine_agreement(evals: DataFrame) -> DataFrame:
    """For each engine pair, positions both answered (same run and puzzle) and
    how often they chose the same move.

    Answers are counted by (run, puzzle, engine, move) first, so repeated answers
    weigh as they would in a join of the table with itself; the counts of one
    position (at most engines x moves) give its pair counts inside its row,
    and every task sums them by pair before the last shuffle.
    """
    answers = evals.groupBy("run_id", "puzzle_id", "engine", "engine_move").agg(F.count(F.lit(1)).alias("n"))
    position = (answers.where(F.col("engine").isNotNull()).groupBy("run_id", "puzzle_id")
                .agg(F.collect_list(F.struct("engine", "engine_move", "n")).alias("given")))
    same = lambda x, y: F.coalesce(x["engine_move"] == y["engine_move"], F.lit(False))
    pairs = F.flatten(F.transform("given", lambda x: F.transform(
        F.filter("given", lambda y: y["engine"] > x["engine"]),
        lambda y: F.struct(x["engine"].alias("engine_a"), y["engine"].alias("engine_b"), (x["n"] * y["n"]).alias("n"),
                           F.when(same(x, y), x["n"] * y["n"]).otherwise(0).alias("same")))))
    out = (position.where("run_id is not null and puzzle_id is not null").select(F.inline(pairs)).groupBy("engine_a", "engine_b")
           .agg(F.sum("n").alias("positions"), F.sum("same").alias("agreements")))
    return out.withColumn("agreement_pct", round_half_away(F.col("agreements") * 100.0 / F.col("positions"), 2))


def depth_histogram(evals: DataFrame, by=("engine",)) -> DataFrame:
    """Number of answers per search depth."""
    return evals.groupBy(*by, "depth").agg(F.count(F.lit(1)).alias("n"))


def depth_percentiles(evals: DataFrame, by=("engine",), pcts=(25, 50, 75, 90)) -> DataFrame:
    """Exact discrete percentiles of depth (PERCENTILE_DISC semantics).

    Computed from the depth histogram: the histogram is partially aggregated
    (one row per group and distinct depth), so a group holding a third of
    all rows never has to be gathered into one task; the cumulative counts
    run over the small histogram only.
    """
    h = depth_histogram(evals.where(F.col("depth").isNotNull()), by)
    w = Window.partitionBy(*by).orderBy("depth")
    cum = (h.withColumn("cum", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("total", F.sum("n").over(Window.partitionBy(*by))))
    # smallest depth whose cumulative share reaches p percent (integer arithmetic, no float ties)
    aggs = [F.min(F.when(F.col("cum") * 100 >= F.lit(p) * F.col("total"), F.col("depth"))).alias(f"p{p}")
            for p in pcts]
    return cum.groupBy(*by).agg(F.max("total").alias("n"), *aggs)


def engine_ids(engines: DataFrame, name: str = "engine") -> DataFrame:
    """Display name -> engine id."""
    return engines.select(F.col(name).alias("engine"), safe_name(name).alias("engine_id")).distinct()
