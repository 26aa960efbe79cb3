"""Packing into optimal length buckets.

A row's length is given as a column of token counts (``token_counts.count_tokens``),
or estimated: a token per ``TOKEN_BYTES`` bytes, at least one per word, so that a long
run without blanks counts by its size.  Documents are cut into pieces of at most
``max_len`` tokens.  The global histogram of piece lengths (at most ``max_len`` + 1
rows) goes to the driver, where a dynamic program chooses the bucket boundaries
that minimise all padding for the given number of buckets.  Inside a bucket of width
w, batches hold ``budget // w`` pieces, so a padded batch stays within the token budget.

Batches are numbered without gathering a bucket: pieces get a seeded order by
MD5, a bucket of more than ``CHUNK`` pieces is dealt into hash chunks, and each
chunk numbers its own batches; only the last batch of a chunk may be short.

Edge cases: null and empty texts are one piece of length 0; very long
texts become many pieces, none is cut off; repeated rows are packed as often as
they occur; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knightshift.session import cut_lineage

from .common import n_words

MAX_LEN = 2048
BUDGET = 16_384
BUCKETS = 8
SEED = 41
CHUNK = 100_000
TOKEN_BYTES = 4


def estimated_tokens(text: Column) -> Column:
    return F.greatest(n_words(text), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / TOKEN_BYTES).cast("long"))


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper boundaries of at most ``buckets`` buckets with the least total padding (ties: lower boundaries)."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    m = len(lengths)
    if not m:
        return []
    n = np.concatenate(([0], np.cumsum([histogram[int(x)] for x in lengths]))).astype(np.int64)
    words = np.concatenate(([0], np.cumsum([histogram[int(x)] * int(x) for x in lengths]))).astype(np.int64)
    layers = min(buckets, m)
    best = np.concatenate(([0], lengths * n[1:] - words[1:]))      # padding of the first j lengths in one bucket
    came = [np.zeros(m + 1, dtype=np.int64)]
    for b in range(2, layers + 1):
        now, origin = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
        for j in range(b, m + 1):
            i = np.arange(b - 1, j)
            cost = best[i] + lengths[j - 1] * (n[j] - n[i]) - (words[j] - words[i])
            k = int(np.argmin(cost))
            now[j], origin[j] = cost[k], i[k]
        best = now
        came.append(origin)
    out, j = [], m
    for b in range(layers, 0, -1):
        out.append(int(lengths[j - 1]))
        j = int(came[b - 1][j])
    return out[::-1]


def pieces(docs: DataFrame, length: Column, max_len: int, id_col: str) -> DataFrame:
    """Rows (id, piece, start, length), none longer than ``max_len``."""
    n = F.greatest(F.lit(1), F.ceil(length / max_len)).cast("int")
    start = F.col("piece").cast("long") * max_len
    return (docs.select(F.col(id_col).alias("id"), length.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
            .select("id", F.col("piece").cast("long").alias("piece"), start.alias("start"),
                    F.least(F.col("n") - start, F.lit(max_len)).cast("long").alias("length")))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: Column | None = None, max_len: int = MAX_LEN,
         budget: int = BUDGET, buckets: int = BUCKETS, seed: int = SEED, chunk_rows: int = CHUNK) -> DataFrame:
    """One row per piece: id, piece, start, length, bucket_len, chunk, batch, slot, padding.

    ``length`` is the length of a row in tokens; estimated from ``text`` unless given.
    """
    size = F.coalesce(length if length is not None else estimated_tokens(F.col(text)), F.lit(0)).cast("long")
    own = cut_lineage(pieces(docs, size, max_len, id_col), "pieces")
    histogram = {r["length"]: r["count"] for r in own.groupBy("length").count().collect()}
    bounds = boundaries(histogram, buckets) or [0]
    low = [-1, *bounds[:-1]]
    held = [sum(c for x, c in histogram.items() if a < x <= z) for a, z in zip(low, bounds)]

    def by_bucket(values: list[int]) -> Column:
        out = F.when(F.col("length") <= bounds[0], F.lit(values[0]))
        for z, v in zip(bounds[1:], values[1:]):
            out = out.when(F.col("length") <= z, F.lit(v))
        return out.cast("long")

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("piece").cast("string")))
    chunks = by_bucket([max(1, -(-h // chunk_rows)) for h in held])
    fits = by_bucket([max(1, budget // max(1, z)) for z in bounds])
    group = Window.partitionBy("bucket_len", "chunk").orderBy("o", "id", "length")
    return (own.withColumn("o", order).withColumn("bucket_len", by_bucket(bounds))
            .withColumn("chunk", F.conv(F.substring("o", 1, 8), 16, 10).cast("long") % chunks)
            .withColumn("r", F.row_number().over(group).cast("long") - 1).withColumn("fits", fits)
            .select(F.col("id").alias(id_col), "piece", "start", "length", "bucket_len", "chunk",
                    F.floor(F.col("r") / F.col("fits")).cast("long").alias("batch"), (F.col("r") % F.col("fits")).alias("slot"),
                    (F.col("bucket_len") - F.col("length")).alias("padding")))


def pack_sql(table: str = "documents", max_len: int = MAX_LEN, budget: int = BUDGET, buckets: int = BUCKETS, seed: int = SEED,
             chunk_rows: int = CHUNK) -> str:
    """DuckDB SQL for ``pack`` over the estimated tokens of ``text``: one common table expression per layer of the dynamic program."""
    layers = ["d1 AS (SELECT j, (l * sc - sl)::HUGEINT AS f, 0::BIGINT AS i FROM k WHERE j > 0)"]
    for b in range(2, buckets + 1):
        layers.append(f"e{b} AS (SELECT y.j, min((x.f + y.l * (y.sc - q.sc) - (y.sl - q.sl)) * 100000 + x.j) AS s"
                      f" FROM d{b - 1} x JOIN k q ON q.j = x.j JOIN k y ON y.j > x.j GROUP BY y.j)")
        layers.append(f"d{b} AS (SELECT j, s // 100000 AS f, (s % 100000)::BIGINT AS i FROM e{b})")
    every = " UNION ALL ".join(f"SELECT {b} AS b, j, i FROM d{b}" for b in range(1, buckets + 1))
    return f"""WITH RECURSIVE w AS (
  SELECT doc_id, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), (strlen(coalesce(text, '')) + {TOKEN_BYTES - 1}) // {TOKEN_BYTES})::BIGINT AS n FROM {table}),
p AS (SELECT doc_id, n, unnest(range(greatest(1, (n + {max_len - 1}) // {max_len}))) AS piece FROM w),
own AS (SELECT doc_id, piece, piece * {max_len} AS start, least(n - piece * {max_len}, {max_len}) AS length FROM p),
h AS (SELECT length AS l, count(*) AS c FROM own GROUP BY length),
k AS (SELECT 0::BIGINT AS j, 0::BIGINT AS l, 0::HUGEINT AS sc, 0::HUGEINT AS sl UNION ALL
  SELECT row_number() OVER (ORDER BY l), l, sum(c) OVER (ORDER BY l), sum(c * l) OVER (ORDER BY l) FROM h),
{",\n".join(layers)},
every AS ({every}),
back AS (SELECT least({buckets}, max(j)) AS b, max(j) AS j FROM k UNION ALL
  SELECT back.b - 1, every.i FROM back JOIN every ON every.b = back.b AND every.j = back.j WHERE back.b > 1),
bound AS (SELECT k.l AS z, coalesce(lag(k.l) OVER (ORDER BY k.l), -1) AS a FROM back JOIN k USING (j) WHERE k.j > 0),
placed AS (SELECT own.*, z, md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || piece) AS o
  FROM own JOIN bound ON length > a AND length <= z),
dealt AS (SELECT *, ('0x' || substr(o, 1, 8))::BIGINT
    % greatest(1, (count(*) OVER (PARTITION BY z) + {chunk_rows - 1}) // {chunk_rows}) AS chunk FROM placed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY z, chunk ORDER BY o, doc_id, length) - 1 AS r,
    greatest(1, {budget} // greatest(1, z)) AS fits FROM dealt)
SELECT doc_id, piece::BIGINT AS piece, start::BIGINT AS start, length::BIGINT AS length, z::BIGINT AS bucket_len,
  chunk::BIGINT AS chunk, (r // fits)::BIGINT AS batch, (r % fits)::BIGINT AS slot, (z - length)::BIGINT AS padding FROM numbered"""
