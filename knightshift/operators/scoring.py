"""Scoring engine answers against puzzle solutions, resuming, shard reports and
running accuracy (J3, J4, P7, P9, P10, A6, A7, W1, W2, L3, U1, U2)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DEFAULT_ENGINES, count_true, is_correct, round_half_away, safe_name
from ..plans.joins import bounded_broadcast
from .ordered import running_totals


def score_answers(puzzles: DataFrame, answers: DataFrame, evaluated_at=None) -> DataFrame:
    """J3 + P7: join answers to their puzzle and mark them correct or wrong.

    Both sides are shuffled on ``puzzle_id`` (or the puzzle side is broadcast
    when its values measure small and broadcasts are on); ``evaluated_at`` keeps the answer's own
    time or one load timestamp per job.
    """
    p = puzzles.select("puzzle_id", "fen", "solution", "rating")
    if not puzzles.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):   # -1: the session wants none
        p = bounded_broadcast(p)
    j = answers.join(p, "puzzle_id")
    cols = ["run_id", "puzzle_id", "fen", "solution", "engine_move",
            is_correct("engine_move", "solution").alias("is_correct"),
            "depth", "nps", "elapsed_seconds", "rating", "engine", safe_name("engine").alias("engine_id")]
    if "evaluated_at" in answers.columns:
        stamp = F.col("evaluated_at") if evaluated_at is None else F.coalesce("evaluated_at", F.lit(evaluated_at))
        cols.append(stamp.alias("evaluated_at"))
    elif evaluated_at is not None:
        cols.append(F.lit(evaluated_at).alias("evaluated_at"))
    return j.select(*cols)


def resume_pending(work: DataFrame, done: DataFrame, keys=("run_id", "engine", "puzzle_id")) -> DataFrame:
    """What is still to evaluate: the work list minus stored results (anti join)."""
    return work.join(bounded_broadcast(done.select(*keys)), list(keys), "left_anti")


def resume_rows(puzzles: DataFrame, plan: DataFrame, checkpoints: DataFrame, done: DataFrame, min_rating: int | None = None,
                max_puzzles: int | None = None, order: str = "pos") -> DataFrame:
    """Rows of interrupted shards that are still to evaluate: (run_id, engine_id, shard, index, puzzle columns).

    ``plan`` lists (run_id, engine_id, shard); ``checkpoints`` holds ``last_index`` of those that were interrupted,
    ``done`` those with stored results.  Rows are counted from 0 in the order of their shard, behind the rating filter
    and up to ``max_puzzles``, as they are read; a shard starts again at its ``last_index`` (0 without a checkpoint).
    The plan is cut to open shards before it meets any puzzle, so finished shards are neither expanded nor shuffled.
    """
    keys = ["run_id", "engine_id", "shard"]
    open_shards = (plan.select(*keys).join(bounded_broadcast(done.select(*keys).distinct()), keys, "left_anti")
                   .join(bounded_broadcast(checkpoints.select(*keys, "last_index")), keys, "left")
                   .withColumn("first", F.coalesce("last_index", F.lit(0))).drop("last_index"))
    rows = puzzles if min_rating is None else puzzles.where(F.col("rating") >= min_rating)
    place = Window.partitionBy("shard").orderBy(order)                # a shard has a bounded size
    rows = rows.withColumn("index", (F.row_number().over(place) - 1).cast("bigint"))
    if max_puzzles is not None:
        rows = rows.where(F.col("index") < max_puzzles)
    return rows.join(bounded_broadcast(open_shards), "shard").where(F.col("index") >= F.col("first")).drop("first")


def resumed_results(recovered: DataFrame, fresh: DataFrame) -> DataFrame:
    """The results of resumed shards: what the checkpoints held, counted from 0, then the rows evaluated since.

    ``recovered`` as read by ``checkpoint_results``; columns that one side lacks are null.
    """
    held = recovered.withColumn("recovered", F.lit(True))
    return held.unionByName(fresh.withColumn("recovered", F.lit(False)), allowMissingColumns=True)


def normalize_engines(spec) -> list[str]:
    """Engine selection from a space/comma separated string or a list; defaults when empty."""
    if spec is None:
        return list(DEFAULT_ENGINES)
    if isinstance(spec, str):
        items = [e.strip() for e in spec.split(",")]
    else:
        items = []
        for s in spec:
            items.extend(e.strip() for e in str(s).split(","))
    items = [e for e in items if e]
    return items or list(DEFAULT_ENGINES)


def filter_engines(evals: DataFrame, spec) -> DataFrame:
    """Keep the selected engines (an IN list: pushed into the scan as a filter)."""
    return evals.where(F.col("engine").isin(normalize_engines(spec)))


def filter_engines_by_table(evals: DataFrame, selection: DataFrame, column: str = "spec") -> DataFrame:
    """P9, data form: specs in a table column, split and trimmed, then a semi join."""
    names = (selection.select(F.explode(F.split(F.col(column), ",")).alias("engine"))
             .select(F.trim("engine").alias("engine")).where(F.col("engine") != ""))
    return evals.join(names, "engine", "left_semi")


def solved_positions(evals: DataFrame) -> DataFrame:
    """P10: the solved positions export."""
    return (evals.where(F.col("is_correct"))
            .select("puzzle_id", "rating", "engine", "depth", "nps", "elapsed_seconds"))


def shard_report(shards: DataFrame, evals: DataFrame, done: DataFrame, min_rating: int | None = None) -> DataFrame:
    """One row per (run, engine, shard) of the work plan with its status.

    ``already_done`` when a result for the shard was stored before, ``empty``
    when no puzzle of the shard passes the rating filter, else ``completed``
    with totals.  Evaluations are reduced per shard before the join.
    """
    keys = ["run_id", "engine", "shard"]
    ev = evals if min_rating is None else evals.where(F.col("rating") >= min_rating)
    agg = ev.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), count_true("is_correct").alias("solved"))
    d = done.select(*keys).distinct().withColumn("__done", F.lit(True))
    j = shards.select(*keys).join(d, keys, "left").join(agg, keys, "left")
    status = (F.when(F.col("__done"), F.lit("already_done"))
              .when(F.coalesce(F.col("total"), F.lit(0)) == 0, F.lit("empty"))
              .otherwise(F.lit("completed")))
    live = F.col("__done").isNull() & F.col("total").isNotNull()
    return j.select(*keys, status.alias("status"),
                    F.when(live, F.col("total")).alias("total"),
                    F.when(live, F.col("solved")).alias("solved"),
                    F.when(live, round_half_away(F.col("solved") * 100.0 / F.col("total"), 2)).alias("accuracy_pct"))


def running_accuracy(answers: DataFrame, by=("engine",), order=("pos",), solved="is_correct") -> DataFrame:
    """Processed / solved / accuracy so far, per engine in answer order (balanced two-pass)."""
    s = F.when(F.col(solved) if isinstance(solved, str) else solved, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    r = running_totals(answers, list(by), list(order), {"solved_so_far": s}, row_number="processed")
    return r.withColumn("running_accuracy_pct",
                        round_half_away(F.col("solved_so_far") * 100.0 / F.col("processed"), 2))


def limit_per_engine(evals: DataFrame, total: int, by=("run_id", "engine"), order=("shard", "pos")) -> DataFrame:
    """The first ``total`` positions of every engine, taken in shard order."""
    r = running_totals(evals, list(by), list(order), row_number="taken")
    return r.where(F.col("taken") <= total)


def slice_shard(puzzles: DataFrame, k: int, shard: str = "shard", order: str = "pos") -> DataFrame:
    """L3: the first ``k`` rows of every shard (a shard has a bounded size)."""
    w = Window.partitionBy(shard).orderBy(order)
    return puzzles.withColumn("row_in_shard", (F.row_number().over(w) - 1).cast("bigint")).where(F.col("row_in_shard") < k)


def union_results(*frames: DataFrame) -> DataFrame:
    """Union of result sets by column name; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_ids(*frames: DataFrame, column: str = "puzzle_id") -> DataFrame:
    """Union of id sets, each id once."""
    out = frames[0].select(column)
    for f in frames[1:]:
        out = out.union(f.select(column))
    return out.distinct()


def stored_count(ids: DataFrame, column: str = "puzzle_id") -> DataFrame:
    """Number of distinct stored ids (exact)."""
    return ids.agg(F.countDistinct(column).alias("stored"))


def missing_tables(spark: SparkSession, expected, database: str | None = None, present=None) -> DataFrame:
    """Expected table names not present (empty when all exist).

    ``present`` defaults to the tables and views of the catalog."""
    if present is None:
        present = [t.name for t in spark.catalog.listTables(database)]
    exp = spark.createDataFrame([(n,) for n in expected], "table_name string")
    have = spark.createDataFrame([(n,) for n in present], "table_name string")
    return exp.exceptAll(have)


_SAFE = re.compile(r"[ .]")


def safe_name_py(name: str) -> str:
    """P8 for path names on the driver (same rule as :func:`safe_name`)."""
    return _SAFE.sub("_", name.lower())

