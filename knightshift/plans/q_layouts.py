"""Registered queries: stored layouts -- lookups, sketches, incremental loads, catalog tables
(index layouts, A7 and A14 over sketches, C5, K4)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from .. import schemas
from ..operators import normalize as N
from ..operators import rollups as R
from ..operators import sketches as SK
from ..session import checkpoint_root, landed, scratch_path
from ..sinks import files as K
from . import fixtures as fx
from .joins import bounded_broadcast
from .model_fixture import model_tables, with_model
from .registry import query

SHARD_SIZE = 20
# index tables written at a time: the next one's tasks take the cores that the last tasks of a stage leave idle
AT_ONCE = 3
# lookups over the indexes: values of their columns
LOOKUPS = {
    "idx_puzzle_eval_correct": [True], "idx_puzzle_eval_run": ["run_3"], "idx_puzzle_rating": [1777], "idx_games_players": ["u10", "u71"],
    "idx_games_eco": ["A15"], "idx_moves_judgment": ["an inexplicable move"], "idx_moves_fen": ["8/8"], "idx_matches_engines": ["e3", "e2"],
    "idx_match_games_match": ["m17"],
}


def _sql(v) -> str:
    return str(v).lower() if isinstance(v, bool) else repr(v)


def indexed_table(spark, d, name: str) -> str:
    """The table of an index, clustered by its columns (stored once per application)."""
    _, table, columns = next(x for x in schemas.INDEXES if x[0] == name)
    return landed(spark, f"{name}:{d}", lambda path: K.write_clustered(model_tables(spark, d)[table], path, columns, schemas.PRIMARY_KEYS[table]))


@query("index_lookups", with_model("\nUNION ALL\n".join(
    f"SELECT '{n}' AS index_name, count(*) AS found FROM {t} WHERE " + " AND ".join(f"{c} = {_sql(v)}" for c, v in zip(cs, LOOKUPS[n]))
    for n, t, cs in schemas.INDEXES)))
def q_index_lookups(spark, d):
    checkpoint_root(spark)                             # set before the threads ask for it
    with ThreadPoolExecutor(AT_ONCE) as pool:
        paths = list(pool.map(inheritable_thread_target(spark)(lambda x: indexed_table(spark, d, x[0])), schemas.INDEXES))
    found = []
    for (name, _, columns), path in zip(schemas.INDEXES, paths):
        rows = spark.read.parquet(path)
        hit = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(columns, LOOKUPS[name])])
        found.append(rows.where(hit).agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("index_name"), "found"))
    return reduce(lambda a, b: a.unionByName(b), found)


@query("sketched_totals", """
SELECT engine, COUNT(*) AS n, true AS ids_within, true AS ranks_within FROM fx_evals GROUP BY engine""")
def q_sketched_totals(spark, d):
    """Shards sketched in two loads, merged per engine, against the exact answers: both within the stated error."""
    evals = fx.fx_evals(spark, d).withColumn("shard", F.floor(F.col("pos") / SHARD_SIZE).cast("long"))
    path = scratch_path(spark, "sketches")
    SK.sketch_shards(evals.where("shard % 3 > 0"), path, "first")
    SK.sketch_shards(evals, path, "second")            # only the shards that are new
    got = SK.merged(SK.read_sketches(spark, path), ["engine"], (25, 50, 75, 90))
    exact = evals.groupBy(F.col("engine").alias("e")).agg(F.countDistinct("puzzle_id").alias("stored"))
    depths = R.depth_histogram(evals)
    j = got.join(bounded_broadcast(exact), F.col("engine") == F.col("e"))
    ranks = depths.withColumnRenamed("n", "c").join(bounded_broadcast(j), "engine")
    slack = SK.KLL_RANK_ERROR * F.col("n")
    within = [(F.sum(F.when(F.col("depth") < F.col(f"p{p}"), F.col("c")).otherwise(0)) <= F.max(F.col("n") * p / 100.0 + slack))
              & (F.sum(F.when(F.col("depth") <= F.col(f"p{p}"), F.col("c")).otherwise(0)) >= F.max(F.col("n") * p / 100.0 - slack)) for p in (25, 50, 75, 90)]
    return ranks.groupBy("engine").agg(
        F.max("n").alias("n"), F.max(F.abs(F.col("ids") - F.col("stored")) <= 4 * SK.HLL_ERROR * F.col("stored")).alias("ids_within"),
        reduce(lambda a, b: a & b, within).alias("ranks_within"))


@query("normalize_incremental", """
SELECT 'engines' AS table_name, replace(replace(lower(engine), ' ', '_'), '.', '_') AS key, engine AS value FROM (SELECT DISTINCT engine FROM fx_evals) a
UNION ALL SELECT 'benchmark_runs', run_id, CAST(movetime_ms AS VARCHAR) FROM fx_runs
UNION ALL SELECT 'themes', theme, theme FROM (SELECT DISTINCT unnest(string_split_regex(trim(themes), '\\s+')) AS theme FROM fx_puzzles) t WHERE theme <> ''
UNION ALL SELECT 'puzzle_themes', puzzle_id, theme FROM (SELECT DISTINCT puzzle_id, unnest(string_split_regex(trim(themes), '\\s+')) AS theme FROM fx_puzzles) t WHERE theme <> ''
UNION ALL SELECT 'puzzle_evaluations', puzzle_id, run_id || ' ' || engine_id FROM fx_evals""")
def q_normalize_incremental(spark, d):
    """The results of one run, then of all, then of all once more."""
    evals, puzzles, runs = fx.fx_evals(spark, d), fx.fx_puzzles(spark, d), fx.fx_runs(spark).select("run_id", "movetime_ms")
    root = scratch_path(spark, "normalized")
    N.load_results(evals.where("run_id = 'run_a'"), puzzles.where("pos % 2 = 0"), runs.where("run_id = 'run_a'"), root, "one")
    for load in ("two", "three"):
        N.load_results(evals, puzzles, runs, root, load)
    shown = {"engines": ("engine_id", "engine_name"), "benchmark_runs": ("run_id", "movetime_ms"), "themes": ("theme_id", "theme_id"),
             "puzzle_themes": ("puzzle_id", "theme_id"), "puzzle_evaluations": ("puzzle_id", "concat_ws(' ', run_id, engine_id)")}
    parts = [spark.read.parquet(f"{root}/{t}").selectExpr(f"'{t}' AS table_name", f"{k} AS key", f"CAST({v} AS STRING) AS value") for t, (k, v) in shown.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def stored_tables(spark, d) -> dict[str, str]:
    """Puzzles, engines, games and evaluations as stored layouts (once per application)."""
    put = lambda name, build: landed(spark, f"catalog-{name}:{d}", build)
    return {
        "puzzles": put("puzzles", lambda path: K.write_clustered(fx.fx_puzzles(spark, d), path, ["puzzle_id"])),
        "engines": put("engines", lambda path: fx.fx_engines(spark).write.parquet(path)),
        "games": put("games", lambda path: K.write_clustered(fx.fx_games(spark, d), path, ["match_id"], ["game_id"])),
        "evaluations": landed(spark, f"results:{d}", lambda path: K.write_results(fx.fx_evals(spark, d).drop("pos"), path)),
    }


CATALOG_SQL = """
WITH g AS (SELECT lower(white) AS family, COUNT(*) AS games FROM {db}games GROUP BY lower(white))
SELECT e.engine_name, COUNT(*) AS answers, SUM(CASE WHEN v.engine_move = p.solution THEN 1 ELSE 0 END) AS solved,
       MAX(p.rating) AS hardest, MAX(g.games) AS games_as_white
FROM {db}evaluations v JOIN {db}puzzles p ON v.puzzle_id = p.puzzle_id JOIN {db}engines e ON v.engine_id = e.engine_id
LEFT JOIN g ON g.family = split_part(e.engine_id, '_', 1)
WHERE v.run_id = 'run_b' GROUP BY e.engine_name"""


@query("export_csv_catalog", """
WITH g AS (SELECT lower(white) AS family, COUNT(*) AS games FROM fx_games GROUP BY lower(white))
SELECT e.engine_name, COUNT(*) AS answers, CAST(SUM(CASE WHEN v.engine_move = p.solution THEN 1 ELSE 0 END) AS BIGINT) AS solved,
       MAX(p.rating) AS hardest, MAX(g.games) AS games_as_white
FROM fx_evals v JOIN fx_puzzles p ON v.puzzle_id = p.puzzle_id JOIN fx_engines e ON v.engine_id = e.engine_id
LEFT JOIN g ON g.family = split_part(e.engine_id, '_', 1)
WHERE v.run_id = 'run_b' GROUP BY e.engine_name""")
def q_export_csv_catalog(spark, d):
    """K4 over catalog tables: a join of evaluations (partitioned), puzzles, engines and games."""
    database = "ks_" + "".join(c if c.isalnum() else "_" for c in d.lower())
    K.register_tables(spark, stored_tables(spark, d), database)
    path = K.export_csv(spark, CATALOG_SQL.format(db=f"`{database}`."), scratch_path(spark, "export_catalog"))
    kind = "engine_name string, answers bigint, solved bigint, hardest int, games_as_white bigint"
    return spark.read.option("header", True).option("escape", '"').schema(kind).csv(path)
