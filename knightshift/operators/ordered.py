"""Order-dependent numbering without gathering a group into one task.

``Window.partitionBy(engine).orderBy(pos)`` sends every row of an engine to a
single task; when one engine holds a third of all answers that task holds a
third of the data.  ``running_totals`` computes the same row numbers and
running sums in balanced passes:

1. the rows are stored once and cut into contiguous slices of the (group,
   order) key order, of about ``ROWS_PER_CHUNK`` rows each, by the range
   partitioner, so a hot group (nulls too) spans many slices;
2. rows are numbered and summed inside every (group, chunk) -- a window
   whose partitions are chunk-sized;
3. per (group, chunk) totals (partially aggregated; at most groups x chunks
   rows) give each chunk its offset through a small window; the offsets are
   joined back (broadcast by AQE when measured small).

The result equals the one-window form row for row when the order is total.
Boundaries only affect balance, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.joins import bounded_broadcast
from ..session import cut_lineage

ROWS_PER_CHUNK = 200_000
LEAST_ROWS = 2_000          # of a slice when smaller inputs are cut finer


def with_chunks(df: DataFrame, keys: list[str], fine: bool = False) -> DataFrame:
    """``df`` stored, plus ``__chunk``: contiguous slices of the ``keys`` order of about ``ROWS_PER_CHUNK`` rows.

    With ``fine``, an input of fewer slices than the session's shuffle partitions is cut into as many, of
    ``LEAST_ROWS`` at least: worth another pass where the work on a slice is heavy.

    The input is evaluated once, by the write.  More than one slice is assigned by the range partitioner over
    the stored rows (nulls sort first, so a null group is cut like any other) and written with its number, so
    every later pass reads the same slice of a row.
    """
    stored = cut_lineage(df, "rows")
    n = stored.count()
    chunks = -(-n // ROWS_PER_CHUNK)
    if fine:
        chunks = max(chunks, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS)))
    if chunks <= 1:
        return stored.withColumn("__chunk", F.lit(0))
    ranged = stored.repartitionByRange(chunks, *[F.col(k) for k in keys]).withColumn("__chunk", F.spark_partition_id())
    return cut_lineage(ranged, "chunks")


def running_totals(df: DataFrame, partition_by: list[str], order_by: list[str],
                   sums: dict[str, Column] | None = None, row_number: str = "rn",
                   chunk_by: list[str] | None = None, fine: bool = False) -> DataFrame:
    """Adds ``row_number`` (1-based, per group in order) and one running sum per ``sums`` entry.

    ``chunk_by``: columns forming a prefix of ``order_by`` whose values already
    cut the order into bounded slices (for file-ordered data: file and block);
    then no sampling pass is needed.  ``fine``: see ``with_chunks``.
    """
    sums = sums or {}
    base = df.select("*", *[e.alias(f"__v_{k}") for k, e in sums.items()])
    if chunk_by:
        assert list(order_by[:len(chunk_by)]) == list(chunk_by), "chunk_by must prefix order_by"
        base = base.withColumn("__chunk", F.struct(*chunk_by))
    else:
        base = with_chunks(base, partition_by + order_by, fine)
    part = [*partition_by, "__chunk"]
    w = Window.partitionBy(*part).orderBy(*order_by)
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.select("*", F.row_number().over(w).alias("__rn"),
                        *[F.sum(f"__v_{k}").over(frame).alias(f"__s_{k}") for k in sums])
    totals = base.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"),
                                     *[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    before = (Window.partitionBy(*partition_by).orderBy("__chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*[F.col(c).alias(f"__k_{c}") for c in part],
                            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__on"),
                            *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}")
                              for k in sums])
    cond = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in part]
    j = local.join(offsets, cond, "inner")
    return j.select(*[F.col(c) for c in df.columns],
                    (F.col("__rn") + F.col("__on")).alias(row_number),
                    *[(F.col(f"__s_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums])


def file_order_numbers(df: DataFrame, partition_by: list[str], row_number: str = "rn",
                       file: str = "file", block: str = "block", seq: str = "seq",
                       preamble: bool = False) -> DataFrame:
    """Row numbers in file order (file, block start, position in block) per group,
    without moving the rows.

    ``seq`` must be ``monotonically_increasing_id()`` taken right at the scan and
    no row may be filtered between the scan and this call, so the records of one
    file block carry consecutive values.  Only a small per-block table (count
    and first ``seq``) is aggregated and windowed; the rows get their block's
    offset through a join with it.  With ``preamble`` the first record of a file
    (the text before its first separator) is neither counted nor returned.
    """
    keys = [*partition_by, file, block]
    blocks = df.groupBy(*keys).agg(F.min(seq).alias("__s0"), F.count(F.lit(1)).alias("__n"))
    skip = F.when(F.col(block) == 0, 1).otherwise(0) if preamble else F.lit(0)
    blocks = blocks.withColumn("__skip", skip)
    before = Window.partitionBy(*partition_by).orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"__k_{k}") for k in keys], (F.col("__s0") + F.col("__skip")).alias("__s0"),
                           F.coalesce(F.sum(F.col("__n") - F.col("__skip")).over(before), F.lit(0)).alias("__off"))
    cond = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    # the block table is checked against its bound and broadcast: the rows are not shuffled
    j = df.join(bounded_broadcast(blocks), cond, "inner").where(F.col(seq) >= F.col("__s0"))
    return j.select(*[F.col(c) for c in df.columns],
                    (F.col("__off") + F.col(seq) - F.col("__s0") + 1).alias(row_number))
