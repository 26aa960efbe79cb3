"""Incremental normalisation (C5): results, puzzles and manifests to dimensions and
evaluations, load by load.

Every table only gains rows, those whose key no earlier load has stored.  A load
writes under its own name and does not look at what it wrote before, so a load
that was cut off is simply run again, and one that is repeated changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import engine_family, safe_name
from ..plans.joins import bounded_broadcast
from ..sources.puzzles import empty_if_missing
from .rollups import theme_bridge

# --- fixed values: keys of the tables ----------------------------------------
KEYS = {"engines": ["engine_id"], "benchmark_runs": ["run_id"], "themes": ["theme_id"],
        "puzzle_themes": ["puzzle_id", "theme_id"], "puzzle_evaluations": ["run_id", "puzzle_id", "engine_id"]}
# ------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """All loads of a table (empty before the first)."""
    return empty_if_missing(lambda: spark.read.schema(schema).parquet(path), spark, schema)


def merge_rows(rows: DataFrame, path: str, keys: list[str], load: str) -> None:
    """Append the rows whose key no other load holds; of rows that share a key the smallest is taken.

    Rows are reduced per key before they meet the stored keys (an anti join on the keys alone).
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]
    once = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.min(F.struct(*rest) if rest else F.lit(0)).alias("__r"))
    once = once.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in once.schema.fields) + ", load string"
    held = read_table(spark, path, kind).where(F.col("load") != load).select(*keys)
    once.join(bounded_broadcast(held), keys, "left_anti").write.mode("overwrite").parquet(f"{path}/load={load}")


def load_results(evals: DataFrame, puzzles: DataFrame, runs: DataFrame, root: str, load: str) -> None:
    """One load: engines, runs, themes and their bridge, and evaluations (keys and measures only)."""
    bridge = theme_bridge(puzzles)
    tables = {
        "engines": evals.select(safe_name("engine").alias("engine_id"), F.col("engine").alias("engine_name"), engine_family("engine").alias("family")),
        "benchmark_runs": runs, "themes": bridge.select("theme_id"), "puzzle_themes": bridge,
        "puzzle_evaluations": evals.select("run_id", "puzzle_id", safe_name("engine").alias("engine_id"), "engine_move", "is_correct", "depth", "nps", "elapsed_seconds")}
    for name, rows in tables.items():
        merge_rows(rows, f"{root}/{name}", KEYS[name], load)
