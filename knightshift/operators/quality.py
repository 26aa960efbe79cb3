"""Relational checks as jobs (C1-C5): each constraint of the data model becomes
a query that counts its violations.  Every check is one aggregation (partial
+ final) or one anti join; none collects rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import engine_family, safe_name
from ..plans.joins import bounded_broadcast
from .. import schemas


def check_pk(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Duplicate key values and rows with a null key part."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(any_null.cast("int")).alias("nul"))
    return per_key.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("nul") == 1, F.col("n"))), F.lit(0)).cast("bigint").alias("null_key_rows"),
    ).select(F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
             "duplicate_keys", "null_key_rows")


def check_fk(child: DataFrame, column: str, parent: DataFrame, parent_column: str, name: str) -> DataFrame:
    """Non-null child values without a parent row (anti join)."""
    keys = bounded_broadcast(parent.select(F.col(parent_column).alias("__k")))   # small parents map-side
    orphans = child.where(F.col(column).isNotNull()).select(F.col(column).alias("__k")).join(keys, "__k", "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("orphan_rows"),
                       F.countDistinct("__k").alias("orphan_keys")).select(
        F.lit(name).alias("foreign_key"), "orphan_rows", "orphan_keys")


def check_not_null(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """Null count of every NOT NULL column, one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stacked = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return counts.select(F.lit(table).alias("table_name"), F.inline(stacked))


def check_length(df: DataFrame, limits: dict[str, int], table: str) -> DataFrame:
    """C4: values longer than their VARCHAR(n), one pass."""
    aggs = []
    for c, n in limits.items():
        aggs.append(F.count_if(F.length(c) > n).alias(f"{c}__v"))
        aggs.append(F.max(F.length(c)).alias(f"{c}__m"))
    counts = df.agg(*aggs)
    stacked = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(n).alias("max_allowed"),
                                 F.col(f"{c}__m").alias("max_length"), F.col(f"{c}__v").alias("violations"))
                        for c, n in limits.items()])
    return counts.select(F.lit(table).alias("table_name"), F.inline(stacked))


VERDICT = ["constraint_type", "table_name", "column_names", "violations", "detail"]


def check_table(df: DataFrame, table: str) -> DataFrame:
    """C1, C3, C4 of one table of the model in one scan: a row for its key, each NOT NULL column and each length limit.

    Rows are reduced per key value first (a repeated key, a null part), every other count rides along.  ``detail`` is the
    rows with a null key part, the rows of the table, or the largest length.
    """
    keys, limits = schemas.PRIMARY_KEYS[table], schemas.LENGTHS.get(table, {})
    required = schemas.not_null_columns(table)
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    per_key = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.count(F.lit(1)).alias("__n"), F.max(any_null.cast("int")).alias("__nul"),
        *[F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in required],
        *[F.count_if(F.length(c) > n).alias(f"__long_{c}") for c, n in limits.items()],
        *[F.max(F.length(c)).alias(f"__most_{c}") for c in limits])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    once = per_key.agg(
        F.count_if(F.col("__n") > 1).alias("__dup"), total(F.when(F.col("__nul") == 1, F.col("__n"))).alias("__nul"), total("__n").alias("__rows"),
        *[total(f"__null_{c}").alias(f"__null_{c}") for c in required], *[total(f"__long_{c}").alias(f"__long_{c}") for c in limits],
        *[F.coalesce(F.max(f"__most_{c}"), F.lit(0)).cast("bigint").alias(f"__most_{c}") for c in limits])

    def row(kind: str, columns: str, violations: str, detail: str):
        return F.struct(F.lit(kind).alias(VERDICT[0]), F.lit(table).alias(VERDICT[1]), F.lit(columns).alias(VERDICT[2]),
                        F.col(violations).alias(VERDICT[3]), F.col(detail).alias(VERDICT[4]))

    rows = [row("primary_key", ",".join(keys), "__dup", "__nul"), *[row("not_null", c, f"__null_{c}", "__rows") for c in required],
            *[row("length", c, f"__long_{c}", f"__most_{c}") for c in limits]]
    return once.select(F.inline(F.array(*rows)))


def check_references(tables: dict[str, DataFrame]) -> DataFrame:
    """All foreign keys of the model at once: a row per key, ``violations`` orphan rows and ``detail`` orphan values.

    Every child is read once for all its references, which are counted per value before anything else; each parent's
    values are gathered once for all its children; one anti join leaves the orphans.
    """
    names = {(c, col): f"{col}->{p}.{pc}" for c, col, p, pc in schemas.FOREIGN_KEYS}
    held = []
    for child in dict.fromkeys(c for c, _, _, _ in schemas.FOREIGN_KEYS):
        own = [(col, p, pc) for c, col, p, pc in schemas.FOREIGN_KEYS if c == child]
        refs = F.array(*[F.struct(F.lit(names[child, col]).alias("fk"), F.lit(f"{p}.{pc}").alias("parent"), F.col(col).cast("string").alias("value")) for col, p, pc in own])
        held.append(tables[child].select(F.inline(refs)).where("value IS NOT NULL").groupBy("fk", "parent", "value")
                    .agg(F.count(F.lit(1)).alias("n")).withColumn("child", F.lit(child)))
    parents = [tables[p].select(F.lit(f"{p}.{pc}").alias("parent"), F.col(pc).cast("string").alias("value")).where("value IS NOT NULL").distinct()
               for p, pc in dict.fromkeys((p, pc) for _, _, p, pc in schemas.FOREIGN_KEYS)]
    orphans = union_all(held).join(union_all(parents), ["parent", "value"], "left_anti").groupBy("child", "fk").agg(
        F.sum("n").alias("violations"), F.count(F.lit(1)).alias("detail"))
    every = tables[schemas.FOREIGN_KEYS[0][0]].sparkSession.createDataFrame([(c, n) for (c, _), n in names.items()], "child string, fk string")
    zero = F.lit(0).cast("bigint")
    return every.join(orphans, ["child", "fk"], "left").select(
        F.lit("foreign_key").alias(VERDICT[0]), F.col("child").alias(VERDICT[1]), F.col("fk").alias(VERDICT[2]),
        F.coalesce("violations", zero).alias(VERDICT[3]), F.coalesce("detail", zero).alias(VERDICT[4]))


def check_model(tables: dict[str, DataFrame]) -> DataFrame:
    """Every constraint that ``schemas`` declares, over the tables given (all twelve for the references)."""
    return union_all([check_table(df, t) for t, df in tables.items()] + [check_references(tables)])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def normalize_engines(evals: DataFrame) -> DataFrame:
    """The engines dimension derived from denormalized results."""
    e = evals.select("engine").distinct()
    return e.select(safe_name("engine").alias("engine_id"), F.col("engine").alias("engine_name"),
                    engine_family("engine").alias("family"))


def normalize_evaluations(evals: DataFrame) -> DataFrame:
    """Results to 3NF evaluations (keys + measures, no puzzle or engine attributes)."""
    cols = ["run_id", "puzzle_id", safe_name("engine").alias("engine_id"), "engine_move", "is_correct",
            "depth", "nps", "elapsed_seconds"]
    return evals.select(*cols)


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Add a missing column with its declared default (an explicit NULL stays NULL)."""
    out = df
    for c, v in schemas.DEFAULTS.get(table, {}).items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v))
    return out
