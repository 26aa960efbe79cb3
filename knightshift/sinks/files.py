"""Sinks (K1-K5, K8): Parquet tables, CSV export, match text files.

All writes are distributed (one file per task); nothing is collected to the
driver.  Paths are chosen by the caller -- on a cluster a shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# rows that a task of ``write_clustered`` sorts and writes
ROWS_PER_FILE = 1_000_000


def _bloom(writer, *columns: str):
    """Parquet bloom filters on lookup columns (point lookups skip row groups)."""
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer


def write_shards(puzzles: DataFrame, path: str, shard_size: int, numbered: bool = False,
                 mode: str = "append") -> None:
    """K1: zstd Parquet shards of at most ``shard_size`` rows, bloom filters on ids and positions.

    Default: files are cut by ``maxRecordsPerFile`` inside every task.  With
    ``numbered`` the rows carry a ``shard`` column (from ``assign_shards``)
    and each shard becomes its own directory ``shard=N``.
    """
    blooms = [c for c in ("puzzle_id", "fen") if c in puzzles.columns]
    if numbered:
        w = puzzles.repartition("shard").write.mode(mode).option("compression", "zstd")
        _bloom(w, *blooms).partitionBy("shard").parquet(path)
    else:
        w = puzzles.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", shard_size)
        _bloom(w, *blooms).parquet(path)


def write_results(evals: DataFrame, path: str, mode: str = "append") -> None:
    """K2: evaluation results partitioned by run and engine (partition pruning on both),
    sorted by puzzle inside each file with a bloom filter on ``puzzle_id``.

    Range partitioning on (run, engine, puzzle) keeps a hot (run, engine) spread
    over many tasks while each file holds one contiguous, sorted id range."""
    n = int(evals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = (evals.repartitionByRange(n, "run_id", "engine_id", "puzzle_id").sortWithinPartitions("puzzle_id")
         .write.mode(mode).option("compression", "zstd"))
    _bloom(w, "puzzle_id").partitionBy("run_id", "engine_id").parquet(path)


def in_match_order(games: DataFrame) -> DataFrame:
    """Games range partitioned and sorted by match and game.

    The range partitioner evaluates its input twice (for its sample, then for the shuffle): put costly columns behind it.
    """
    n = int(games.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return games.repartitionByRange(n, "match_id", "game_no").sortWithinPartitions("match_id", "game_no")


def write_matches(games: DataFrame, matches_of, root: str, mode: str = "append") -> tuple[str, str]:
    """K3: game and match tables from one parse of the text.

    The games, as ``in_match_order`` gives them (a hot match spreads over files; a lookup of one match reads its
    row groups only, by their statistics and the bloom filter), are written once, and ``matches_of`` derives the
    match rows from the stored games.
    """
    mp, gp = f"{root}/engine_matches", f"{root}/engine_match_games"
    spark = games.sparkSession
    _bloom(games.write.mode(mode).option("compression", "zstd"), "match_id").parquet(gp)
    _bloom(matches_of(spark.read.parquet(gp)).write.mode(mode).option("compression", "zstd"), "match_id").parquet(mp)
    return mp, gp


def export_csv(spark: SparkSession, sql: str, path: str, single_file: bool = False) -> str:
    """K4: any SQL over the registered views to CSV (header, comma, '"' escaping).

    Errors are raised, not printed.  ``single_file`` is meant for small
    results such as rollups; large exports stay one file per task.
    """
    df = spark.sql(sql)
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def game_slices(games: DataFrame) -> DataFrame:
    """``games`` with ``slice``, the range of (match, game) in which each lies, for ``write_games_text``: the range
    partitioner evaluates its input twice, so give it the games before costly columns are joined to them."""
    n = int(games.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return games.repartitionByRange(n, "match_id", "game_id").withColumn("slice", F.spark_partition_id())


def write_games_text(games: DataFrame, path: str, games_per_file: int = 0, text: Column | str = "pgn") -> None:
    """Match text files, one directory per match, games in game order inside each file.

    Range partitioning on (match, game), or their ``slice`` (``game_slices``), keeps a hot match spread over many
    tasks while part-file names preserve the order; ``games_per_file`` cuts files (0: no cut).  ``text`` is evaluated
    behind the shuffle, once a game.
    """
    n = int(games.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = games.repartitionById(n, "slice") if "slice" in games.columns else games.repartitionByRange(n, "match_id", "game_id")
    (ranged.sortWithinPartitions("match_id", "game_id")
     .select("match_id", (F.col(text) if isinstance(text, str) else text).alias("pgn")).write.mode("overwrite")
     .option("maxRecordsPerFile", games_per_file).partitionBy("match_id").text(path))


def export_pgn(games: DataFrame, path: str, order: str = "game_no", column: str = "moves_pgn") -> str:
    """K5: stored game texts, stripped, empty ones skipped, a blank line between games."""
    out = (games.where(F.trim(F.col(column)) != "")
           .orderBy(order).select(F.trim(F.col(column)).alias("value")))
    out.write.mode("overwrite").option("lineSep", "\n\n").text(path)
    return path


def write_manifests(manifests: DataFrame, path: str) -> int:
    """K8: append the manifests of runs that ``path`` does not hold yet (one JSON document a line); returns how many.

    Of manifests that repeat a run inside the input one is kept.
    """
    from ..sources.puzzles import empty_if_missing
    spark = manifests.sparkSession
    existing = empty_if_missing(lambda: spark.read.schema(manifests.schema).json(path), spark, manifests.schema)
    fresh = register_runs(manifests.dropDuplicates(["run_id"]), existing)
    before = existing.count()
    fresh.write.mode("append").json(path)
    return spark.read.schema(manifests.schema).json(path).count() - before


def next_shard(spark: SparkSession, path: str) -> int:
    """K1: the number of the next shard directory of a numbered store (0 for a new one): one past the largest."""
    from ..sources.puzzles import empty_if_missing
    kind = "puzzle_id string, shard int"
    last = empty_if_missing(lambda: spark.read.schema(kind).parquet(path), spark, kind).agg(F.max("shard")).first()[0]
    return 0 if last is None else last + 1


def register_runs(manifests: DataFrame, existing: DataFrame) -> DataFrame:
    """K8: manifests whose run is not yet registered (append these only).
    Registered runs are a dimension: broadcast when their count is within the bound."""
    from ..plans.joins import bounded_broadcast
    return manifests.join(bounded_broadcast(existing.select("run_id")), "run_id", "left_anti")


def write_clustered(df: DataFrame, path: str, columns: list[str], spread_by: list[str] = (), row_group_bytes: int | None = None) -> None:
    """A table laid out for lookups by ``columns`` (one or several, together or a leading part of them).

    Rows are range partitioned and sorted by the columns, so that the row groups hold narrow ranges of them and a
    lookup reads the groups whose statistics meet its value; Bloom filters decide inside wide ranges.
    ``spread_by`` (a key) goes behind them in the ranges, so that a value that a third of all rows share spreads over many
    files, each a range of the key.  Inside a file rows of equal columns are in no order: a sort by the key behind a column
    of few values compares whole rows all the time and took a third of the work, while no lookup by the columns reads less for it.
    A file takes about ``ROWS_PER_FILE`` rows at most, so that a task sorts in memory however large the table is.

    ``df`` is evaluated three times (its count, the partitioner's sample, the shuffle): give it stored rows or a projection of them.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_FILE))
    ranges = [*columns, *(c for c in spread_by if c not in columns)]
    w = df.repartitionByRange(n, *ranges).sortWithinPartitions(*columns).write.mode("overwrite").option("compression", "zstd")
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    texts = [c for c in columns if df.schema[c].dataType.typeName() != "boolean"]
    _bloom(w, *texts).parquet(path)


def register_tables(spark: SparkSession, paths: dict[str, str], database: str) -> None:
    """The stored layouts as tables of a catalog database, for SQL over all of them (K4).

    Schemas and partition columns come from the files; the tables are external, so dropping or registering them again
    leaves the data alone.  Register again after files were added.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, path in paths.items():
        spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{name}`")
        spark.catalog.createTable(f"`{database}`.`{name}`", path=path, source="parquet")
        if any(c.isPartition for c in spark.catalog.listColumns(f"`{database}`.`{name}`")):
            spark.catalog.recoverPartitions(f"`{database}`.`{name}`")
