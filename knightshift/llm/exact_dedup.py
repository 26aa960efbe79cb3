"""Exact duplicates through an extendible-hash index on shared files.

A text's key is its 64-bit hash.  The directory of the index is indexed by the
top bits of the key: it starts with one bucket and, while a bucket holds more
than ``capacity`` bytes, that bucket is split on its next bit, doubling the
directory whenever the bucket already uses every bit of it.  Bucket loads come
from one grouped sum over key ranges, as many as the bytes ask for (``MAX_BITS``
bits at most).

Index files: each Arrow batch first folds its own equal texts into one entry
(key, SHA-256, count, largest id, the columns of that row), so a text that a third
of all rows share reaches its bucket once per batch.  Entries are written below
``spark.checkpoint.dir`` as a table bucketed by directory bucket, whose numbers are
chosen so that every file gets its own.  An owner task reads the key ranges of its
buckets, without a further shuffle, chains the entries of equal key and compares
their bytes: only equal bytes form a group, whatever the hash says.

The ids of a group are nowhere gathered: the rows, narrowed to id, key and SHA-256,
meet the group of their text again, broadcast if the groups measure small; else
groups of over a hundredth of all rows are broadcast and the others shuffled.

Of equal texts the row with the largest id stays (null ids are the smallest; of
tied rows one stays).  Edge cases: null texts count as empty and equal each
other; very long texts are compared whole; repeated rows are copies of each
other; an empty table gives an empty result; other columns pass through
``kept_rows`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knightshift.plans.joins import BROADCAST_BYTES
from knightshift.session import cut_lineage, scratch_path

from .common import join_groups

CAPACITY = 32 << 20
MAX_BITS = 20               # key ranges counted: at most 2 ** MAX_BITS numbers reach the driver
MAX_FILES = 100_000         # buckets of a Spark table

ENTRY = T.StructType([
    T.StructField("__bucket", T.IntegerType()), T.StructField("__key", T.LongType()),
    T.StructField("__sha", T.StringType()), T.StructField("__n", T.LongType()),
    T.StructField("__top", T.LongType()), T.StructField("__text", T.StringType()),
])
GROUP = T.StructType([
    T.StructField("__gkey", T.LongType()), T.StructField("__gsha", T.StringType()),
    T.StructField("__keep", T.LongType()), T.StructField("__size", T.LongType()),
])


class Directory:
    """Bucket of each prefix of ``depth`` bits, built by splitting overfull buckets."""

    def __init__(self, loads: np.ndarray, capacity: int):
        """``loads``: bytes of each key range, by their top bits (a power of two of them)."""
        total = np.concatenate(([0], np.cumsum(loads)))
        bits = int(np.log2(len(loads)))
        self.depth, self.slots = 0, [(0, 0)]      # (prefix, local depth) of each slot
        todo = [(0, 0)]
        while todo:
            prefix, local = todo.pop()
            width = bits - local
            load = total[(prefix + 1) << width] - total[prefix << width]
            if load <= capacity or local == bits:
                continue
            if local == self.depth:               # the bucket uses every bit: double the directory
                self.slots = [s for s in self.slots for _ in range(2)]
                self.depth += 1
            halves = [(prefix << 1, local + 1), (prefix << 1 | 1, local + 1)]
            span = 1 << (self.depth - local - 1)
            at = prefix << (self.depth - local)
            for k, half in enumerate(halves):
                self.slots[at + k * span:at + (k + 1) * span] = [half] * span
            todo += halves
        number = {slot: i for i, slot in enumerate(dict.fromkeys(self.slots))}
        self.table = np.array([number[s] for s in self.slots], dtype=np.int32)
        self.n_buckets = len(number)

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Directory bucket of signed 64-bit keys."""
        top = keys.view(np.uint64) >> np.uint64(63) >> np.uint64(1) if not self.depth else \
            keys.view(np.uint64) >> np.uint64(64 - self.depth)
        return self.table[top.astype(np.int64)]


def build_directory(keyed: DataFrame, capacity: int = CAPACITY) -> Directory:
    """Directory for the frame's ``__key`` and ``__bytes``: a grouped sum over the key ranges that the bytes ask for."""
    total = keyed.agg(F.coalesce(F.sum("__bytes"), F.lit(0))).first()[0]
    bits = min(MAX_BITS, max(4, int(np.ceil(np.log2(total / capacity + 1))) + 4))
    cell = F.shiftrightunsigned("__key", 64 - bits)
    loads = np.zeros(1 << bits, dtype=np.int64)
    for r in keyed.groupBy(cell.alias("cell")).agg(F.sum("__bytes").alias("load")).toLocalIterator():
        loads[r["cell"]] = r["load"]
    return Directory(loads, capacity)


def bucket_numbers(spark: SparkSession, buckets: int, files: int) -> np.ndarray:
    """A number for each directory bucket such that the table's hash deals bucket b to file b % files."""
    each, size = -(-buckets // files), 2 * buckets + 64
    while True:
        drawn = spark.range(size).select(F.col("id").cast("int").alias("number")).withColumn("file", F.pmod(F.hash("number"), F.lit(files)))
        held: list[list[int]] = [[] for _ in range(files)]
        for r in drawn.orderBy("number").toLocalIterator():
            held[r["file"]].append(r["number"])
        if min(map(len, held)) >= each:
            return np.array([held[b % files][b // files] for b in range(buckets)], dtype=np.int32)
        size *= 2


def entries(keyed: DataFrame, directory: Directory, numbers: np.ndarray, carry: list[str]) -> DataFrame:
    """Fold the equal texts of each Arrow batch into index entries, with the ``carry`` columns of the top row."""
    schema = T.StructType(ENTRY.fields + [keyed.schema[c] for c in carry])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for i, text in enumerate(batch.column("__text").to_pylist()):
                found.setdefault(text, []).append(i)
            ids = batch.column("__id").to_pylist()
            low = -(1 << 63)
            tops = [max(rows, key=lambda i: low if ids[i] is None else ids[i]) for rows in found.values()]
            own = batch.take(pa.array(tops, type=pa.int64()))
            keys = np.asarray(own.column("__key"))
            columns = [pa.array(numbers[directory.bucket(keys)], pa.int32()), own.column("__key"),
                       pa.array([hashlib.sha256(t.encode()).hexdigest() for t in found], pa.string()),
                       pa.array([len(rows) for rows in found.values()], pa.int64()), own.column("__id"), own.column("__text")]
            yield pa.RecordBatch.from_arrays(columns + [own.column(c) for c in carry], names=schema.names)

    return keyed.mapInArrow(fold, schema)


def write_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: list[str] = (),
                capacity: int = CAPACITY) -> DataFrame:
    """Write the index of ``docs`` to shared files and return its entries.

    The table is bucketed by directory bucket.  Its name lives in the session's catalog only.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    renamed = {c: f"__c{i}" for i, c in enumerate(carry)}
    keyed = docs.select(F.col(id_col).cast("long").alias("__id"), body.alias("__text"), F.xxhash64(body).alias("__key"),
                        *[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    loads = docs.select(F.xxhash64(body).alias("__key"), (F.octet_length(body) + 64).alias("__bytes"))
    directory = build_directory(loads, capacity)
    spark = docs.sparkSession
    files = max(1, min(directory.n_buckets, MAX_FILES))
    numbers = bucket_numbers(spark, directory.n_buckets, files)
    rows = entries(keyed, directory, numbers, list(renamed.values())).withColumn("__entry", F.monotonically_increasing_id())
    name = f"ks_index_{uuid.uuid4().hex[:12]}"
    (rows.repartition(files, "__bucket").write.format("parquet").option("path", scratch_path(spark, "hash-index"))
     .bucketBy(files, "__bucket").saveAsTable(name))
    index = spark.table(name)
    index.table_name = name
    return index


def _owner_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: chain entries of equal key, compare bytes, and give every group its largest id and size."""
    chains: dict[int, list[int]] = {}             # key -> groups of its chain
    texts, keys, shas, size, best = [], [], [], [], []
    for batch in batches:
        column = batch.column("__text")
        rows = zip(*(batch.column(c).to_pylist() for c in ("__key", "__sha", "__n", "__top")))
        for i, (key, sha, n, top) in enumerate(rows):
            text = column[i].as_buffer().to_pybytes()
            chain = chains.setdefault(key, [])
            g = next((g for g in chain if texts[g] == text), None)
            if g is None:
                g = len(texts)
                chain.append(g)
                for held, value in ((texts, text), (keys, key), (shas, sha), (size, 0), (best, None)):
                    held.append(value)
            size[g] += n
            if top is not None and (best[g] is None or top > best[g]):
                best[g] = top
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shas, pa.string()), pa.array(best, pa.int64()), pa.array(size, pa.int64())],
                                     names=GROUP.names)


def groups(index: DataFrame) -> DataFrame:
    """Key, SHA-256, largest id and size of every group of equal texts, by its owner task."""
    return (index.select("__bucket", "__key", "__sha", "__top", "__n", "__text")
            .groupBy("__bucket").applyInArrow(_owner_groups, GROUP))


def assign(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    index = write_index(docs, id_col, text, capacity=capacity)
    found = cut_lineage(groups(index), "groups")
    docs.sparkSession.sql(f"DROP TABLE {index.table_name}")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut_lineage(docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(body).alias("__key"), F.sha2(body, 256).alias("__sha"),
                                   F.monotonically_increasing_id().alias("__row")), "keyed-rows")
    total = rows.count()
    same = (F.col("__key") == F.col("__gkey")) & (F.col("__sha") == F.col("__gsha"))
    # of the rows that share the largest id, repeated ones, the first stays
    stays = (join_groups(rows, found, same, "__gsha", "__size", total, max_bytes).where(F.col("__id").eqNullSafe(F.col("__keep")))
             .groupBy("__gkey", "__gsha").agg(F.min("__row").alias("__stay")))
    told = cut_lineage(found.join(stays, ["__gkey", "__gsha"]), "told-groups")
    return (join_groups(rows, told, same, "__gsha", "__size", total, max_bytes)
            .select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"),
                    (F.col("__row") == F.col("__stay")).alias("kept"), F.col("__sha").alias("text_sha256")))


def _owner_keeps(names: list[str]):
    """One bucket: of each chain of equal bytes, the carried columns of the row with the largest id."""
    def owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (-(1 << 63), -1)
        chains: dict[int, list[list]] = {}        # key -> [text, (top, entry), row]
        for batch in batches:
            keys, texts = batch.column("__key").to_pylist(), batch.column("__text")
            tops, own = batch.column("__top").to_pylist(), batch.column("__entry").to_pylist()
            for i, key in enumerate(keys):
                text = texts[i].as_buffer().to_pybytes()
                chain = chains.setdefault(key, [])
                link = next((x for x in chain if x[0] == text), None)
                if link is None:
                    chain.append(link := [text, low, None])
                rank = (low[0] if tops[i] is None else tops[i], own[i])
                if rank > link[1]:
                    link[1], link[2] = rank, (batch, i)
        by_batch: dict[int, tuple[pa.RecordBatch, list[int]]] = {}
        for chain in chains.values():
            for _, _, (batch, i) in chain:
                by_batch.setdefault(id(batch), (batch, []))[1].append(i)
        for batch, rows in by_batch.values():
            yield batch.take(pa.array(rows, pa.int64())).select(names)
    return owner


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    carry = [c for c in docs.columns if c != text]
    flagged = docs.withColumn("__null", F.col(text).isNull())
    index = write_index(flagged, id_col, text, [*carry, "__null"], capacity)
    schema = T.StructType([index.schema["__text"], *(index.schema[f"__c{i}"] for i in range(len(carry) + 1))])
    own = index.select("__bucket", "__key", "__entry", "__top", *schema.names)
    stay = own.groupBy("__bucket").applyInArrow(_owner_keeps(schema.names), schema)
    back = {c: F.col(f"__c{i}") for i, c in enumerate(carry)}
    back[text] = F.when(~F.col(f"__c{len(carry)}"), F.col("__text"))
    return stay.select(*[back[c].alias(c) for c in docs.columns])
