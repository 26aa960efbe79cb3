"""Live metrics and report texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import engine_family, fixed, live_band, report_band, solved_of_total, speed_label
from .scoring import running_accuracy

METRICS = ["running_accuracy_pct", "depth", "nps", "elapsed_seconds", "puzzle_rating", "solved_binary"]


def metrics_long(answers: DataFrame, by=("engine",), order=("pos",)) -> DataFrame:
    """K7: the per-position metric log in long form (engine, step, metric, value).

    ``step`` is the position's running index per engine; metric names carry
    the engine prefix like the tracker keys (``engine/metric``).
    """
    r = running_accuracy(answers, by=by, order=order)
    wide = r.select(*by, F.col("processed").alias("step"),
                    F.col("running_accuracy_pct").cast("double").alias("running_accuracy_pct"),
                    F.col("depth").cast("double").alias("depth"), F.col("nps").cast("double").alias("nps"),
                    F.col("elapsed_seconds").cast("double").alias("elapsed_seconds"),
                    F.col("rating").cast("double").alias("puzzle_rating"),
                    F.when(F.col("is_correct"), 1.0).otherwise(0.0).alias("solved_binary"))
    long = wide.unpivot([*by, "step"], METRICS, "metric", "value")
    return long.withColumn("metric", F.concat(F.col(by[0]), F.lit("/"), F.col("metric")))


def live_view(answers_running: DataFrame) -> DataFrame:
    """The live line of one position: accuracy band and compact speed."""
    return answers_running.select("*", live_band("running_accuracy_pct").alias("band"),
                                  speed_label("nps").alias("speed"),
                                  fixed("running_accuracy_pct", 1).alias("accuracy_text"))


def summary_report(rollup: DataFrame) -> DataFrame:
    """P20: the dashboard rows: 'solved / total', accuracy text and band, speed and times."""
    return rollup.select(
        "engine", solved_of_total("solved", "total_puzzles").alias("solved_of_total"),
        F.concat(fixed("accuracy_pct", 2), F.lit("%")).alias("accuracy"),
        report_band("accuracy_pct").alias("band"),
        F.format_number("avg_nps", 0).alias("avg_nps_text"),
        fixed("avg_depth", 1).alias("avg_depth_text"),
        F.concat(fixed("avg_sec", 3), F.lit("s")).alias("avg_time"),
        F.concat(fixed("total_sec", 1), F.lit("s")).alias("total_time"),
        engine_family("engine").alias("family"))
