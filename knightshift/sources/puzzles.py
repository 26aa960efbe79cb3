"""Puzzle sources (S1-S5, S11): the raw dump, the quoted CSV, Parquet shards and results.

The raw dump is read as text lines and split on commas (the dump has no
quoting); columns are found by header name, so optional columns may be
absent.  Every line keeps an order key (file, block, position in block) so
"first occurrence" and "first N" are defined without a global sort.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import bounded_broadcast

# --- fixed values: header names of the puzzle dump ---------------------------------
REQUIRED = ["PuzzleId", "FEN", "Moves", "Rating"]
OPTIONAL = ["Popularity", "Themes", "GameUrl"]
CSV_COLUMNS = ["PuzzleId", "FEN", "Moves", "Rating", "RatingDeviation", "Popularity", "NbPlays",
               "Themes", "GameUrl", "OpeningTags"]
SHARD_SCHEMA = T.StructType([
    T.StructField("puzzle_id", T.StringType()), T.StructField("fen", T.StringType()),
    T.StructField("solution", T.StringType()), T.StructField("rating", T.IntegerType()),
    T.StructField("popularity", T.IntegerType()), T.StructField("themes", T.StringType()),
])
# ------------------------------------------------------------------------------------


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _ordered(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("seq"))


def read_puzzle_dump(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Raw dump lines -> (file, block, seq, n_fields, header-named columns).

    Plain or compressed text (``.zst``, ``.gz`` ...) is read by the text
    source; header lines are located by content, in any order of columns and one
    per file if files differ (only distinct header lines reach the driver).
    A compressed file is not splittable (one task reads it): ``partitions``
    spreads the lines over that many tasks right after the order keys are
    taken, so parsing and the board work run in parallel.
    """
    text = _ordered(spark.read.text(path))
    named = F.transform(F.split(F.col("value"), ",", -1), _strip)
    is_header = F.lit(True)
    for name in ("PuzzleId", "FEN", "Moves"):
        is_header = is_header & F.array_contains(named, name)
    heads = text.where(F.contains(F.col("value"), F.lit("PuzzleId")) & is_header)
    lines = [r[0] for r in heads.select("value").distinct().collect()]      # the few header lines in use
    if not lines:
        raise ValueError(f"no header line in {path}")
    headers = {line: [h.strip() for h in line.split(",")] for line in lines}
    for own in headers.values():
        missing = [h for h in REQUIRED if h not in own]
        if missing:
            raise ValueError(f"dump header lacks {missing}")
    if partitions:
        text = text.repartition(partitions)
    known = [h for h in REQUIRED + OPTIONAL if any(h in own for own in headers.values())]
    if len(headers) == 1:
        own = next(iter(headers.values()))
        rows = text.where(F.col("value") != lines[0]).select("file", "block", "seq", named.alias("parts"))
        cols = {h: F.try_element_at("parts", F.lit(own.index(h) + 1)) for h in known}
        return rows.select("file", "block", "seq", F.size("parts").alias("n_fields"), F.lit(len(own)).alias("n_header"),
                           *[v.alias(k) for k, v in cols.items()])
    # files with headers of their own: a file's columns are found by its own header
    by_file = heads.groupBy(F.col("file").alias("__file")).agg(F.min_by("value", "seq").alias("__line"))
    bare = text.select("file").distinct().join(by_file, F.col("file") == F.col("__file"), "left_anti").limit(1).collect()
    if bare:
        raise ValueError(f"the files of {path} have different headers and {bare[0][0]} has none")
    joined = text.join(bounded_broadcast(by_file), F.col("file") == F.col("__file")).where(~F.col("value").isin(lines))
    own = F.transform(F.split(F.col("__line"), ",", -1), _strip)
    rows = joined.select("file", "block", "seq", named.alias("parts"), own.alias("own"))
    found = {h: F.try_element_at("parts", F.nullif(F.array_position("own", h), F.lit(0)).cast("int")) for h in known}
    if "Popularity" in found:       # a file without the column has the default
        found["Popularity"] = F.when(F.array_contains("own", "Popularity"), found["Popularity"]).otherwise(F.lit("100"))
    return rows.select("file", "block", "seq", F.size("parts").alias("n_fields"), F.size("own").alias("n_header"),
                       *[v.alias(k) for k, v in found.items()])


def read_puzzle_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Quoted CSV with a header; every column read as a string (no inference).

    ``multiline`` allows quoted line breaks but makes each file one task.
    """
    df = (spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
          .option("mode", "PERMISSIVE").option("inferSchema", False).csv(path))
    return _ordered(df)


def read_shards(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S3: all Parquet shards under ``path``, with the shard file name for ordering."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path)
    return df.withColumn("shard_file", F.col("_metadata.file_name"))


def existing_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ``puzzle_id`` column of every readable shard (unreadable files skipped)."""
    schema = T.StructType([T.StructField("puzzle_id", T.StringType())])
    return (spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
            .select("puzzle_id"))


def read_results(spark: SparkSession, paths, schema: T.StructType | None = None) -> DataFrame:
    """Result Parquet by glob(s); an empty match gives an empty frame of ``schema``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    r = spark.read.option("mergeSchema", True)
    if schema is None:
        return r.parquet(*paths)
    return empty_if_missing(lambda: r.schema(schema).parquet(*paths), spark, schema)


def empty_if_missing(read, spark: SparkSession, schema) -> DataFrame:
    """``read()``, or an empty frame of ``schema`` if its path does not exist (no other error is swallowed)."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def puzzle_lookup(puzzles: DataFrame, puzzle_id: str | None = None, date=None) -> DataFrame:
    """One puzzle by id, or the puzzle of a day (both pushed into the scan)."""
    cond = F.lit(False)
    if puzzle_id is not None:
        cond = cond | (F.col("puzzle_id") == puzzle_id)
    if date is not None:
        cond = cond | (F.col("daily_date") == F.lit(date).cast("date"))
    return puzzles.where(cond)
