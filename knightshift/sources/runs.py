"""Run manifests and evaluation checkpoints (S6, S7): small JSON documents read as
data, with per-field defaults and corrupt-file tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import DEFAULT_ENGINES

# --- fixed values: manifest fields and their defaults -------------------------------
MANIFEST_DEFAULTS = {
    "movetime_ms": 500, "total_puzzles": 5000, "concurrency": 1, "engines": DEFAULT_ENGINES,
    "min_rating": None, "use_wandb": False, "wandb_project": "engine-benchmark",
}
# --------------------------------------------------------------------------------------

MANIFEST_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("movetime_ms", T.IntegerType()),
    T.StructField("total_puzzles", T.IntegerType()), T.StructField("concurrency", T.IntegerType()),
    T.StructField("engines", T.ArrayType(T.StringType())), T.StructField("min_rating", T.IntegerType()),
    T.StructField("use_wandb", T.BooleanType()), T.StructField("wandb_project", T.StringType()),
    T.StructField("created_at", T.StringType()),
])

RESULT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("puzzle_id", T.StringType()),
    T.StructField("fen", T.StringType()), T.StructField("solution", T.StringType()),
    T.StructField("solution_san", T.StringType()), T.StructField("engine_move", T.StringType()),
    T.StructField("engine_move_san", T.StringType()), T.StructField("is_correct", T.BooleanType()),
    T.StructField("depth", T.LongType()), T.StructField("nps", T.DoubleType()),
    T.StructField("elapsed_seconds", T.DoubleType()), T.StructField("rating", T.LongType()),
    T.StructField("engine", T.StringType()), T.StructField("evaluated_at", T.StringType()),
])

CHECKPOINT_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("last_index", T.IntegerType()),
    T.StructField("results", T.ArrayType(RESULT_SCHEMA)),
])


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One manifest document per file -> run parameters.

    A field absent from the document takes its default; a field present with
    ``null`` stays null (as ``dict.get`` behaves).  Files are read whole (each
    is one small document), parsed with a fixed schema, never inferred.
    """
    docs = spark.read.text(path, wholetext=True).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"))
    parsed = docs.select("file", F.from_json("value", MANIFEST_SCHEMA).alias("m"),
                         F.json_object_keys("value").alias("keys"))
    cols = [F.col("m.run_id").alias("run_id")]
    for name, default in MANIFEST_DEFAULTS.items():
        present = F.array_contains(F.coalesce("keys", F.array().cast("array<string>")), name)
        field = MANIFEST_SCHEMA[name].dataType
        lit = F.lit(None).cast(field) if default is None else (
            F.array(*[F.lit(x) for x in default]) if isinstance(default, list) else F.lit(default).cast(field))
        cols.append(F.when(present, F.col(f"m.{name}")).otherwise(lit).alias(name))
    cols.append(F.col("m.created_at").alias("created_at"))
    # a document that does not parse gives an all-null record: skipped like an unreadable file
    return parsed.where(F.col("m.run_id").isNotNull()).select(*cols, "file")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Partial results of interrupted shards, one row per stored result.

    A checkpoint that cannot be parsed counts as absent (start from 0): the
    permissive reader yields an all-null record for it, which is dropped.
    """
    ck = (spark.read.schema(CHECKPOINT_SCHEMA).option("mode", "PERMISSIVE").json(path)
          .select("*", F.col("_metadata.file_path").alias("file")))
    ok = ck.where(F.col("run_id").isNotNull())
    return ok.select("last_index", "file", F.inline_outer("results"))


def read_checkpoint_state(spark: SparkSession, path: str) -> DataFrame:
    """One row per readable checkpoint: (engine_id, shard) from its folder, run_id, last_index (0 if absent), results.

    Checkpoints lie below ``engine_id=<id>/shard=<n>``, a file each, or, many in a file, below ``engine_id=<id>`` with
    the shard in the document.  One that cannot be parsed is left out: its shard starts from 0.
    """
    schema = T.StructType([*CHECKPOINT_SCHEMA.fields, T.StructField("engine_id", T.StringType()), T.StructField("shard", T.LongType())])
    ck = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    empty = F.array().cast(CHECKPOINT_SCHEMA["results"].dataType)
    return ck.where(F.col("run_id").isNotNull()).select(
        "run_id", "engine_id", "shard", F.coalesce("last_index", F.lit(0)).alias("last_index"), F.coalesce("results", empty).alias("results"))


def checkpoint_results(state: DataFrame) -> DataFrame:
    """The results that checkpoints hold, with their ``index`` in the shard."""
    own = state.select("run_id", "engine_id", "shard", F.posexplode("results").alias("index", "r"))
    fields = [f.name for f in RESULT_SCHEMA.fields if f.name != "run_id"]
    return own.select("run_id", "engine_id", "shard", F.col("index").cast("bigint").alias("index"), *[F.col(f"r.{c}").alias(c) for c in fields])
