"""Join planning helpers.

Broadcasting is only requested for a side whose measured bytes are within a
bound; above it a sort-merge join is asked for.  Left to itself the planner goes
by the size of the files, and a compressed file of 5 MB may hold columns of 500.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of the values of a broadcast side, and what a row costs besides its values.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 16


def _row_bytes(df: DataFrame):
    """Bytes of a row's values as an expression: lengths of texts, 8 for numbers, the JSON text of nested values."""
    size = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            size = size + 8
    return size


def measured(df: DataFrame) -> DataFrame:
    """One row: the bytes of the values of ``df``, summed in every task before the sums meet."""
    return df.agg(F.coalesce(F.sum(_row_bytes(df).cast("long")), F.lit(0)).alias("bytes"))


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if its values measure at most ``max_bytes``, else ``df`` to be joined by sort-merge.

    The measuring job reads ``df`` once more, in parallel, and moves one number a task; give it a written table
    (``cut_lineage``) where ``df`` is costly.
    """
    return F.broadcast(df) if fits(df, max_bytes) else df.hint("merge")


def fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the values of ``df`` measure at most ``max_bytes``."""
    return measured(df).first()["bytes"] <= max_bytes
