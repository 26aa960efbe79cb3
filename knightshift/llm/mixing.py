"""Mixing sources to target weights by subset-sum budget fitting.

Sources, in code-point order (null last), have weights 5, 2, 1, 5, 2, 1, ... and
share ``share`` times all words; a source's target stops at ``limit`` times its
words and the excess is shared again by weight until no target is above.

A source takes all its documents as often as its target covers them whole.  For
the remaining budget its documents are counted by exact length and a subset of
them is fitted to the budget: a proportional share of every length first, then
long documents, and for the last stretch a bounded-knapsack dynamic program over
the lengths still left.  Where that misses the budget (few documents, or long ones
that outweigh the rest), the lengths are settled longest first so that the shorter
ones can fill what remains, and then by the program over the whole budget, exact up
to ``8 * WINDOW`` words and in steps of ``budget / (8 * WINDOW)`` above; the nearest
of these is taken.  How many documents of each (source, length) are taken
is then turned into a threshold on a seeded hash of the id, so that the choice
repeats on every run and needs no shuffle of the texts.

Only one row per source reaches the driver.  The plan of a source works on its
length counts, not on its documents; the ranks behind the thresholds split a
group of more than ``CHUNK`` documents of one source and length into hash chunks.

Edge cases: null and wordless texts have size 0 and take 0 words; null sources
are a source of their own; rows that agree in id, size and source are taken
alike; a source without words has target 0; empty tables give empty results.
Extra columns pass through ``mixed_rows`` unchanged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from knightshift.plans.joins import bounded_broadcast
from knightshift.session import cut_lineage

from .common import n_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = 23
CHUNK = 100_000
WINDOW = 1 << 17            # words of budget left to the dynamic program, about
PLAN_BYTES = 32 << 20       # of the plan, measured, that may be broadcast


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> dict[str | None, float]:
    """Target words of each source (water filling under the limits)."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    rest, free = share * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if rest * weight[s] / total > limit * sizes[s]]
        if not full:
            return out | {s: rest * weight[s] / total for s in free}
        for s in full:
            out[s] = float(limit * sizes[s])
        rest -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that they sum to the largest reachable value up to ``budget``."""
    steps: list[tuple[int, int, int]] = []        # (length index, items, words), by binary splitting
    made = np.full(budget + 1, -1, dtype=np.int64)  # the step that first reached a sum
    made[0] = len(lengths) * 64
    for i in np.flatnonzero((lengths <= budget) & (counts > 0) & (lengths > 0)):
        left, part = int(min(counts[i], budget // lengths[i])), 1
        while left and made[budget] < 0:
            part = min(part, left)
            words = int(part * lengths[i])
            fresh = np.flatnonzero((made[:budget + 1 - words] >= 0) & (made[words:] < 0)) + words
            made[fresh] = len(steps)
            steps.append((int(i), part, words))
            left, part = left - part, part * 2
        if made[budget] >= 0:
            break
    take, at = np.zeros(len(lengths), dtype=np.int64), int(np.flatnonzero(made >= 0)[-1])
    while at:
        i, part, words = steps[made[at]]
        take[i] += part
        at -= words
    return take


def coarse_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, step: int) -> np.ndarray:
    """As ``knapsack``, longest first and with one sum kept for every ``step`` words (sums themselves are exact)."""
    steps: list[tuple[int, int, int]] = []
    made = np.full(budget // step + 1, -1, dtype=np.int64)
    sums = np.zeros(len(made), dtype=np.int64)
    made[0] = len(lengths) * 64
    for i in np.argsort(-lengths, kind="stable"):
        if made[-1] >= 0:
            break
        left, part = int(min(counts[i], budget // lengths[i])) if lengths[i] > 0 else 0, 1
        while left and made[-1] < 0:
            part = min(part, left)
            words = int(part * lengths[i])
            new = sums[made >= 0] + words
            new = new[new <= budget]
            new = new[made[new // step] < 0]
            made[new // step] = len(steps)
            sums[new // step] = new
            steps.append((int(i), part, words))
            left, part = left - part, part * 2
    take, at = np.zeros(len(lengths), dtype=np.int64), int(sums.max())
    while at:
        i, part, words = steps[made[at // step]]
        take[i] += part
        at -= words
    return take


def shared(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """A proportional share of every length, long documents, and the dynamic program for the rest."""
    total = int((lengths * counts).sum())
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= WINDOW:
            break
        if lengths[i] > 0:
            k = min(int(counts[i] - take[i]), max(0, left - WINDOW) // int(lengths[i]))
            take[i] += k
            left -= k * int(lengths[i])
    return take + knapsack(lengths, counts - take, min(left, 8 * WINDOW))


def settled(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Longest first, a share of every length that leaves no more than the shorter ones can fill; then the dynamic program."""
    take = np.zeros(len(lengths), dtype=np.int64)
    left, rest = budget, int((lengths * counts).sum())      # rest: words of the lengths not yet settled
    for i in np.argsort(-lengths, kind="stable"):
        if left <= WINDOW or lengths[i] <= 0:
            break
        x, c = int(lengths[i]), int(counts[i])
        share = c * left // rest if rest else 0
        rest -= c * x
        take[i] = min(max(share, -((rest - left) // x)), c, left // x)
        left -= int(take[i]) * x
    return take + knapsack(lengths, counts - take, min(left, 8 * WINDOW))


def whole(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The dynamic program over the whole budget, above ``8 * WINDOW`` words in coarse steps and once more for the rest."""
    if budget <= 8 * WINDOW:
        return knapsack(lengths, counts, budget)
    take = coarse_knapsack(lengths, counts, budget, -(-budget // (8 * WINDOW)))
    left = budget - int((lengths * take).sum())
    return take + knapsack(lengths, counts - take, min(left, 8 * WINDOW))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for ``budget`` words."""
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    missed = lambda take: budget - int((lengths * take).sum())
    best = shared(lengths, counts, budget)
    if missed(best):
        best = min(best, settled(lengths, counts, budget), key=missed)
    if missed(best) * 8 * WINDOW >= budget:       # a step of the coarse program or more; any miss of a smaller budget
        best = min(best, whole(lengths, counts, budget), key=missed)
    return best


def narrow(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    """id, source, size and seeded hash of each row."""
    return docs.select(F.col(id_col).alias("id"), F.col(source).alias("src"), n_words(F.col(text)).alias("size"),
                       F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"))


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per (src, size): source_size, target, whole rounds, and the threshold of the documents taken once more.

    ``rows`` come from ``narrow`` and should be a written table: they are read three times.
    """
    spark = rows.sparkSession
    counts = cut_lineage(rows.groupBy("src", "size").agg(F.count("*").alias("n")), "length-counts")
    sizes = {r["src"]: int(r["words"]) for r in counts.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}
    goal = targets(sizes, weights, share, limit)
    schema = T.StructType([T.StructField("src", rows.schema["src"].dataType), T.StructField("source_size", T.LongType()),
                           T.StructField("target", T.DoubleType())])
    known = spark.createDataFrame([(s, n, float(goal[s])) for s, n in sizes.items()], schema)

    def budget(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size", ignore_index=True)
        words, target = int(part["source_size"][0]), float(part["target"][0])
        rounds = int(target // words) if words else 0
        lengths, n = part["size"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        part["rounds"] = rounds
        part["extra"] = fit(lengths, n, int(math.floor(target - rounds * words + 0.5)))
        return part

    joined = counts.join(F.broadcast(known), counts["src"].eqNullSafe(known["src"])).select(
        counts["src"], "size", "n", "source_size", "target")
    out = T.StructType(joined.schema.fields + [T.StructField("rounds", T.LongType()), T.StructField("extra", T.LongType())])
    quota = cut_lineage(joined.groupBy("src").applyInPandas(budget, out)
                        .withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "quota")

    part = quota.where("extra > 0 and extra < n").select(F.col("src").alias("s"), F.col("size").alias("z"), "extra", "chunks")
    own = (rows.join(part, rows["src"].eqNullSafe(part["s"]) & (rows["size"] == part["z"]))
           .withColumn("chunk", F.pmod("h", "chunks").cast("int")))
    group = Window.partitionBy("s", "z").orderBy("chunk")
    cut = (own.groupBy("s", "z", "extra", "chunk").agg(F.count("*").alias("k"))
           .withColumn("before", F.sum("k").over(group) - F.col("k"))
           .where("before < extra and extra <= before + k")
           .select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("chunk").alias("c2"), (F.col("extra") - F.col("before")).alias("rank")))
    last = (own.join(cut, own["s"].eqNullSafe(cut["s2"]) & (own["z"] == cut["z2"]) & (own["chunk"] == cut["c2"]))
            .withColumn("r", F.row_number().over(Window.partitionBy("s", "z", "chunk").orderBy("h", "id")))
            .where("r = rank")
            .select(F.col("s").alias("s3"), F.col("z").alias("z3"), F.col("chunk").alias("last_chunk"), F.col("h").alias("last_h"), F.col("id").alias("last_id")))
    return cut_lineage(
        quota.join(last, quota["src"].eqNullSafe(last["s3"]) & (quota["size"] == last["z3"]), "left")
        .select(F.col("src").alias("__src"), F.col("size").alias("__size"), F.col("source_size").alias("__source_size"),
                F.col("target").alias("__target"), F.col("rounds").alias("__rounds"), F.col("chunks").alias("__chunks"),
                F.when(F.col("extra") == 0, -1).when(F.col("extra") == F.col("n"), F.col("chunks")).otherwise(F.col("last_chunk")).alias("__chunk"),
                F.col("last_h").alias("__h"), F.col("last_id").alias("__id")), "mix-plan")


def copies(rows: DataFrame, planned: DataFrame, id_col: str, source: str, size: str, h: str) -> DataFrame:
    """``rows`` with their source's figures and ``__copies``, how often each is taken."""
    joined = rows.join(bounded_broadcast(planned, PLAN_BYTES),
                       rows[source].eqNullSafe(planned["__src"]) & (rows[size] == planned["__size"]))
    chunk = F.pmod(F.col(h), F.col("__chunks")).cast("int")
    before = (F.col(h) < F.col("__h")) | ((F.col(h) == F.col("__h")) & (F.col(id_col).isNull() | (F.col(id_col) <= F.col("__id"))))
    more = (chunk < F.col("__chunk")) | ((chunk == F.col("__chunk")) & F.coalesce(before, F.lit(False)))
    return joined.withColumn("__copies", F.col("__rounds") + F.when(more, 1).otherwise(0))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken."""
    rows = cut_lineage(narrow(docs, id_col, text, source, seed), "sizes")
    found = copies(rows, plan(rows), "id", "src", "size", "h")
    return found.select(F.col("id").alias(id_col), "size", F.col("__source_size").alias("source_size"),
                        F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, columns unchanged."""
    rows = cut_lineage(narrow(docs, id_col, text, source, seed), "sizes")
    own = docs.withColumn("__n", n_words(F.col(text))).withColumn("__hash", F.xxhash64(F.lit(seed), F.col(id_col)))
    found = copies(own, plan(rows), id_col, source, "__n", "__hash").where("__copies > 0")
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__k")).drop("__k")
