"""Prefix trie of rebuilt conversations, in balanced parentheses.

*Rebuilding.*  The turns of a conversation are numbered in order (balanced, so
that one conversation may hold a third of all rows); a conversation takes the
first turns of its donor in place of as many of its own.  From here on a turn is
a digest of its role and text and its number of words; texts do not travel.

*Classes.*  Conversations of equal turn sequences form a class, named by its
smallest member; only the class goes on, with its number of members and the hash
of their ids.  A node is named by its depth and two running exclusive-or sums of
the turns' positional hashes (running sums by blocks of ``BLOCK`` turns).

*Shards.*  A node that one class alone passes needs no tree: behind the first of
these every value follows from the class.  What is left, the part of each class
that it shares plus one node, is one row of node names.  Sorted by these, the
rows are in depth-first order; the range partitioner cuts them into shards.  A
shard writes its trie as balanced parentheses, ``(`` down and ``)`` up, with the
excess kept in a range min-max tree of blocks.  *findclose* delimits every
subtree; the rank of ``()`` pairs counts its leaves, cumulative arrays over the
opening parentheses give its members and savings.

*Spines.*  The nodes on the first and the last path of a shard may go on in the
neighbouring shards.  Their loose parts (what hangs off a spine beside it) are
merged by the same encoding over all spines in one pass: at most two paths a
shard.  Nodes that hang off a spine take its merged smallest member by a join.

Edge cases: a null role or text is empty; turns of equal number stand in the
order of their digests, null numbers first; repeated rows are repeated turns;
rows without a conversation id belong to no conversation and are left out; a
conversation whose turns all give way to an absent donor is turnless, a member
of the root alone; an empty table has no node.  Very long texts are hashed
whole.  The names of the shared part of one conversation (16 bytes a turn) are
held by one task.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knightshift.operators.ordered import running_totals
from knightshift.plans.joins import bounded_broadcast
from knightshift.session import cut_lineage

from .common import CRC_TABLE_SQL, crc32_sql, join_groups, n_words

GROUP = 20                  # conversations c - c % GROUP .. share their beginning
HEADS = 4                   # so many lengths of the shared beginning: 0 .. HEADS - 1
BLOCK = 4096                # turns of one window partition
IDS = 256                   # member ids in one piece of text
SHARD_ROWS = 100_000        # classes of one shard
FAN_OUT = 64                # parentheses in a block, blocks in a block of blocks
NONE = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- rebuilding

def shared_length(conv_id: Column) -> Column:
    """Turns that a conversation takes from its donor."""
    return (F.crc32(conv_id.cast("string")) % HEADS).cast("long")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, place, g, words): the turns of each conversation in order, from 1."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    framed = F.concat(F.octet_length(part("role")).cast("string"), F.lit(":"), part("role"), part("text"))
    own = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(framed).alias("g"), n_words(F.col("text")).alias("words"))
    return running_totals(own, ["conv_id"], ["turn", "g"], row_number="place").select("conv_id", "place", "g", "words")


def rebuilt_turns(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns (conv_id, depth, g, words) after the exchange of the beginnings."""
    convs = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    heads = (numbered.where((F.col("place") < HEADS) & (F.col("conv_id") % GROUP == 0))
             .groupBy(F.col("conv_id").alias("donor"))
             .agg(F.sort_array(F.collect_list(F.struct("place", "g", "words"))).alias("head")))     # at most HEADS - 1 turns
    told = (convs.withColumn("h", shared_length(F.col("conv_id")))
            .join(heads, F.col("conv_id") - F.col("conv_id") % GROUP == F.col("donor"), "left")
            .select("conv_id", "own", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<place:long,g:string,words:long>>")), F.lit(1), F.col("h").cast("int")).alias("head")))
    told = cut_lineage(told, "trie-heads")
    taken = told.select("conv_id", F.inline("head")).select("conv_id", F.col("place").alias("depth"), "g", "words")
    block = F.expr(f"place div {BLOCK}")
    spread = told.select(F.col("conv_id").alias("c"), "h", F.size("head").alias("given"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"own div {BLOCK}"))).alias("b"))
    own = (numbered.join(spread, (F.col("conv_id") == F.col("c")) & (block == F.col("b"))).where(F.col("place") > F.col("h"))
           .select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("depth"), "g", "words"))
    lanes = [F.xxhash64(F.lit(seed), F.col("g"), F.col("depth")).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    rebuilt = cut_lineage(taken.unionByName(own).select("conv_id", "depth", "words", *lanes), "trie-turns")
    return told.select("conv_id"), rebuilt


# ------------------------------------------------------------------- classes

def id_hashes(members: DataFrame) -> DataFrame:
    """Rows (rep, ends): SHA-256 of the comma-joined ids of each group of members (rep, conv_id), ascending.

    A digest is sequential, so a long list is read in pieces of ``IDS`` ids, in order, by one incremental hash.
    """
    placed = running_totals(members, ["rep"], ["conv_id"], row_number="place")
    pieces = (placed.groupBy("rep", F.expr(f"(place - 1) div {IDS}").alias("piece"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("text")))
    pieces = cut_lineage(pieces, "trie-ids")
    long_lists = pieces.where("piece > 0").select("rep").distinct()

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, str]] = []
        now, running = None, hashlib.sha256()
        for batch in batches:
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if rep != now:
                    if now is not None:
                        done.append((now, running.hexdigest()))
                    now, running = rep, hashlib.sha256(text.encode())
                else:
                    running.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist([{"rep": r, "ends": e} for r, e in done], _ENDS)
            done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"rep": now, "ends": running.hexdigest()}], _ENDS)

    small = bounded_broadcast(long_lists)
    short = pieces.join(small, "rep", "left_anti").select("rep", F.sha2("text", 256).alias("ends"))
    long = pieces.join(small, "rep", "left_semi").repartition("rep").sortWithinPartitions("rep", "piece").mapInArrow(in_order, "rep long, ends string")
    return short.unionByName(long)


_ENDS = pa.schema([("rep", pa.int64()), ("ends", pa.string())])


def classes_of(convs: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows (rep, m, length, total, ends): conversations of equal sequences under their smallest id."""
    whole = rebuilt.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"), F.sum("words").alias("total"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    named = cut_lineage(convs.join(whole, "conv_id", "left").select("conv_id", *map(zero, ("length", "total", "a", "b"))), "trie-convs")
    sequence = ["length", "a", "b"]
    found = cut_lineage(named.groupBy(*sequence).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.max("total").alias("total")), "trie-classes")
    alone = found.where("m = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends"))
    copies = found.where("m > 1").select(*[F.col(c).alias(f"c_{c}") for c in sequence], "rep", "m")
    same = (F.col("length") == F.col("c_length")) & (F.col("a") == F.col("c_a")) & (F.col("b") == F.col("c_b"))
    members = join_groups(named, copies, same, "rep", "m", named.count()).select("rep", "conv_id")
    ends = id_hashes(members).unionByName(alone)
    return cut_lineage(found.join(ends, "rep").select("rep", "m", "length", "total", "ends"), "trie-ends")


def named_turns(rebuilt: DataFrame, classes: DataFrame) -> DataFrame:
    """Turns of the classes' representatives with node names: (rep, depth, words, so_far, a, b), block by block."""
    spread = classes.where("length > 0").select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"length div {BLOCK}"))).alias("blk"))
    rows = rebuilt.withColumn("blk", F.expr(f"depth div {BLOCK}")).withColumnRenamed("conv_id", "rep").join(spread, ["rep", "blk"])
    part = Window.partitionBy("rep", "blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("rep", "blk", "depth", "words", F.sum("words").over(part).alias("so_far"), F.bit_xor("a").over(part).alias("a"), F.bit_xor("b").over(part).alias("b"))
    before = Window.partitionBy("rep").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("rep", "blk").agg(F.sum("words").alias("w"), F.bit_xor("a").alias("x"), F.bit_xor("b").alias("y"))
    zero = F.lit(0).cast("long")
    offsets = sums.select("rep", "blk", F.coalesce(F.sum("w").over(before), zero).alias("w"), F.coalesce(F.bit_xor("x").over(before), zero).alias("x"),
                          F.coalesce(F.bit_xor("y").over(before), zero).alias("y"))
    return (local.join(offsets, ["rep", "blk"])
            .select("rep", "blk", "depth", "words", (F.col("so_far") + F.col("w")).alias("so_far"), F.col("a").bitwiseXOR(F.col("x")).alias("a"), F.col("b").bitwiseXOR(F.col("y")).alias("b")))


def with_fringe(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes with ``fringe``: the depth of the first node that no other class passes, or the length if there is none."""
    nodes = named.groupBy("depth", "a", "b").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    own = nodes.where("rep = other").groupBy("rep").agg(F.min("depth").alias("fringe"))
    return cut_lineage(classes.join(own, "rep", "left").withColumn("fringe", F.coalesce("fringe", "length")), "trie-fringe")


# ------------------------------------------------------ balanced parentheses

class Parens:
    """A forest given by the depths of its nodes in preorder, as balanced parentheses.

    ``open`` is the position of each node's opening parenthesis; ``levels`` are the excess and its minima over
    blocks, blocks of blocks and so on.
    """

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        closes = depth - np.append(depth[1:], depth[0] if n else 0) + 1          # parentheses closed behind each node
        step = np.ones(n + int(closes.sum()), np.int64)
        self.open = np.arange(n) + np.concatenate(([0], np.cumsum(closes)[:-1])) if n else np.zeros(0, np.int64)
        step[:] = -1
        step[self.open] = 1
        self.depth = depth
        self.levels = [np.cumsum(step)]
        while len(self.levels[-1]) > FAN_OUT:
            low = self.levels[-1]
            padded = np.append(low, np.full(-len(low) % FAN_OUT, np.iinfo(np.int64).max))
            self.levels.append(padded.reshape(-1, FAN_OUT).min(axis=1))
        pair = np.zeros(len(step), np.int64)
        if n:
            pair[self.open] = step[self.open + 1] == -1                          # an opening one closed at once: a leaf
        self.pairs = np.concatenate(([0], np.cumsum(pair)))

    def _scan(self, level: int, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """First index from ``start`` on, inside its block, whose value is at most ``limit``; -1 if there is none."""
        low = self.levels[level]
        out = np.full(len(start), -1, np.int64)
        for a in range(0, len(start), 1 << 14):
            s, t = start[a:a + (1 << 14), None], limit[a:a + (1 << 14), None]
            at = s + np.arange(FAN_OUT)
            inside = (at // FAN_OUT == s // FAN_OUT) & (at < len(low))
            hit = inside & (low[np.minimum(at, len(low) - 1)] <= t)
            first = hit.argmax(axis=1)
            out[a:a + (1 << 14)] = np.where(hit[np.arange(len(first)), first], s[:, 0] + first, -1)
        return out

    def _next(self, level: int, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
        found = self._scan(level, start, limit)
        open_ = np.flatnonzero(found < 0)
        if len(open_) and level + 1 < len(self.levels):
            block = self._next(level + 1, start[open_] // FAN_OUT + 1, limit[open_])
            found[open_] = self._scan(level, block * FAN_OUT, limit[open_])
        return found

    def findclose(self) -> np.ndarray:
        """The closing parenthesis of every node: the next place where the excess is below that at its opening."""
        return self._next(0, self.open + 1, self.levels[0][self.open] - 1)

    def ends(self, close: np.ndarray) -> np.ndarray:
        """One past the preorder number of the last node in each subtree."""
        return np.arange(len(close)) + (close - self.open + 1) // 2

    def leaves(self, close: np.ndarray) -> np.ndarray:
        return self.pairs[close + 1] - self.pairs[self.open]

    def parents(self) -> np.ndarray:
        """Preorder number of each node's parent, -1 at roots: the last node of the depth above."""
        out = np.full(len(self.depth), -1, np.int64)
        order = np.argsort(self.depth, kind="stable")
        cut = np.flatnonzero(np.diff(self.depth[order])) + 1
        above = None
        for nodes in np.split(order, cut):
            if above is not None and len(nodes):
                out[nodes] = above[np.searchsorted(above, nodes) - 1]
            above = nodes
        return out


def subtree_sums(weight: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(weight)))
    return total[end] - total[:-1]


def subtree_minima(value: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Smallest value in each preorder interval [i, end), by intervals of powers of two."""
    n = len(value)
    start = np.arange(n)
    power = np.frexp((end - start).astype(float))[1] - 1
    out, table = np.empty(n, np.int64), value.copy()
    for k in range(int(power.max()) + 1 if n else 0):
        here = np.flatnonzero(power == k)
        out[here] = np.minimum(table[here], table[end[here] - (1 << k)])
        if (1 << k) < n:
            table[:n - (1 << k)] = np.minimum(table[:n - (1 << k)], table[1 << k:])
    return out


# -------------------------------------------------------------------- shards

_SHARD = pa.schema([("spine", pa.bool_()), ("place", pa.int64()), ("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()),
                    ("up_a", pa.int64()), ("up_b", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
                    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                    ("words", pa.int64()), ("ends_sha256", pa.string())])
SHARD = ("spine boolean, place long, depth long, a long, b long, up_a long, up_b long, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string")
FAR = np.iinfo(np.int64).max


def preorder(names: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trie of sorted distinct paths that all begin with the root: path i is names[cut[i]:cut[i + 1]] (rows of two values).

    Returns the index into ``names`` of each node in preorder, its depth (from 0) and, per path, its last node.
    """
    n, size = len(cut) - 1, np.diff(cut)
    common = np.zeros(n, np.int64)
    if n > 1:
        both = np.minimum(size[1:], size[:-1])
        at = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both)
        same = (names[np.repeat(cut[:-2], both) + at] == names[np.repeat(cut[1:-1], both) + at]).all(axis=1)
        common[1:] = np.minimum.reduceat(np.where(same, np.repeat(both, both), at), np.cumsum(both) - both)
    depth = np.arange(int(size.sum())) - np.repeat(cut[:-1], size)
    new = depth >= np.repeat(common, size)
    node = np.flatnonzero(new)
    last = np.searchsorted(node, cut[1:] - 1, side="right") - 1
    return node, depth[node], last


def shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one shard, sorted by path, to nodes: whole ones, and the loose parts of the spines."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    col = lambda name: table.column(name).combine_chunks()
    rep, m, length, fringe, tail = (col(c).to_numpy() for c in ("rep", "m", "length", "fringe", "tail"))
    steps = col("steps")
    flat, size = steps.flatten(), np.diff(steps.offsets.to_numpy())
    held = [flat.field(c).to_numpy() for c in ("a", "b", "words")]
    shard = int(col("shard")[0].as_py())
    # each path begins at the root, which has the name (0, 0) and no words
    cut = np.concatenate(([0], np.cumsum(size + 1)))
    is_root = np.zeros(cut[-1], bool)
    is_root[cut[:-1]] = True
    name, words = np.zeros((cut[-1], 2), np.int64), np.zeros(cut[-1], np.int64)
    name[~is_root, 0], name[~is_root, 1], words[~is_root] = held
    node, depth, last = preorder(name, cut)
    name, words = name[node], words[node]
    n = len(node)

    tree = Parens(depth)
    close = tree.findclose()
    end, up = tree.ends(close), tree.parents()
    members, least, lone = np.zeros(n, np.int64), np.full(n, FAR), np.zeros(n, np.int64)
    np.add.at(members, last, m)
    np.minimum.at(least, last, rep)
    goes_on = length > fringe                                  # the class goes on alone below its last node here
    lone[last[goes_on]] = 1
    tails = np.zeros(n, np.int64)
    tails[last] = np.where(goes_on, (m - 1) * tail, 0)
    ends = np.full(n, NONE, dtype=object)
    stops = ~goes_on
    ends[last[stops]] = np.array(col("ends").to_pylist(), dtype=object)[stops]

    spine = np.zeros(n, bool)
    for path in (last[0], last[-1]):
        while path >= 0 and not spine[path]:
            spine[path] = True
            path = up[path]
    n_convs, smallest = subtree_sums(members, end), subtree_minima(least, end)
    saved = subtree_sums(np.where(spine, 0, (n_convs - 1) * words) + tails, end)
    children = np.bincount(up[up >= 0], minlength=n) + lone
    leaves = tree.leaves(close)
    # loose parts: what a spine node has itself and in the subtrees that leave the spine at it
    off = np.flatnonzero(~spine & (up >= 0) & spine[up])
    loose = {k: np.zeros(n, np.int64) for k in ("members", "saved", "children", "leaves")}
    low = least.copy()
    loose["members"] += members
    loose["saved"] += tails
    loose["children"] += lone
    loose["leaves"] += lone
    for key, value in (("members", n_convs), ("saved", saved), ("leaves", leaves), ("children", np.ones(n, np.int64))):
        np.add.at(loose[key], up[off], value[off])
    np.minimum.at(low, up[off], smallest[off])
    pick = lambda whole, part: np.where(spine, part, whole)
    above = np.maximum(up, 0)
    under_spine = (up >= 0) & spine[above]
    out = [spine, (shard << 40) + np.arange(n), depth, name[:, 0], name[:, 1], name[above, 0], name[above, 1],
           pick(smallest, low), np.where(under_spine | (up < 0), -1, smallest[above]), pick(n_convs, loose["members"]),
           pick(children, loose["children"]), pick(leaves, loose["leaves"]), pick(saved, loose["saved"]), words]
    columns = [pa.array(x, f.type) for x, f in zip(out, _SHARD)]
    columns[8] = pa.array(out[8], pa.int64(), mask=under_spine | (up < 0))
    yield pa.RecordBatch.from_arrays([*columns, pa.array(ends, pa.string())], schema=_SHARD)


def merged_spines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spine rows of all shards, in order, to whole nodes: equal names are one node, in order of first sight."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    col = {f.name: table.column(f.name).combine_chunks() for f in _SHARD}
    num = {k: v.to_numpy() for k, v in col.items() if k not in ("spine", "ends_sha256", "parent_conv_id")}
    key = np.column_stack([num["depth"], num["a"], num["b"]])
    _, first, which = np.unique(key, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first))
    first, which, n = first[order], rank[which.reshape(-1)], len(first)
    part = {}
    for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
        part[k] = np.zeros(n, np.int64)
        np.add.at(part[k], which, num[k])
    low = np.full(n, FAR)
    np.minimum.at(low, which, num["conv_id"])
    ends = np.full(n, NONE, dtype=object)
    said = np.array(col["ends_sha256"].to_pylist(), dtype=object)
    told = np.flatnonzero(said != NONE)
    ends[which[told]] = said[told]
    words = num["words"][first]

    tree = Parens(num["depth"][first])
    close = tree.findclose()
    end, up = tree.ends(close), tree.parents()
    n_convs, smallest = subtree_sums(part["n_convs"], end), subtree_minima(low, end)
    children = part["n_children"] + np.bincount(up[up >= 0], minlength=n)
    leaves = subtree_sums(part["n_leaves"] + (children == 0), end)
    saved = subtree_sums(part["saved_tokens"] + (n_convs - 1) * words, end)
    above = np.maximum(up, 0)
    out = [np.ones(n, bool), num["place"][first], num["depth"][first], num["a"][first], num["b"][first], num["a"][first][above], num["b"][first][above],
           smallest, smallest[above], n_convs, children, leaves, saved, words]
    columns = [pa.array(x, f.type) for x, f in zip(out, _SHARD)]
    columns[8] = pa.array(smallest[above], pa.int64(), mask=up < 0)
    yield pa.RecordBatch.from_arrays([*columns, pa.array(ends, pa.string())], schema=_SHARD)


# --------------------------------------------------------------------- nodes

def trie(turns: DataFrame) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text)."""
    convs, rebuilt = rebuilt_turns(numbered_turns(turns))
    classes = classes_of(convs, rebuilt)
    named = cut_lineage(named_turns(rebuilt, classes), "trie-named")
    classes = with_fringe(named, classes)

    blocks = classes.where("length > 0").select("rep", "fringe", "m", "total", "length", "ends",
                                                F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"length div {BLOCK}"))).alias("blk"))
    rows = named.join(blocks, ["rep", "blk"])
    behind = (F.col("m") - 1) * (F.col("total") - F.col("so_far") + F.col("words"))
    last = F.col("depth") == F.col("length")
    alone = rows.where("depth > fringe").select(
        "depth", F.col("rep").alias("conv_id"), F.col("rep").alias("parent_conv_id"), F.col("m").alias("n_convs"),
        (~last).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), behind.alias("saved_tokens"),
        F.when(last, F.col("ends")).otherwise(F.lit(NONE)).alias("ends_sha256"))

    # a name as 8 big-endian bytes of each half: the bytes of a path sort depth first
    step = F.struct("depth", "a", "b", "words", "so_far")
    shared = rows.where("depth <= fringe").groupBy("rep").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    paths = (classes.join(shared, "rep", "left")
             .withColumn("steps", F.coalesce("steps", F.array().cast("array<struct<depth:long,a:long,b:long,words:long,so_far:long>>")))
             .withColumn("path", F.array_join(F.transform("steps", lambda s: F.concat(F.lpad(F.hex(s["a"]), 16, "0"), F.lpad(F.hex(s["b"]), 16, "0"))), ""))
             .withColumn("tail", F.when(F.size("steps") > 0, F.col("total") - F.element_at(F.col("steps.so_far"), -1)).otherwise(F.lit(0)).cast("long")))
    paths = cut_lineage(paths.drop("total"), "trie-paths")
    shards = max(1, -(-paths.count() // SHARD_ROWS))
    sorted_ = (paths.repartitionByRange(shards, "path").sortWithinPartitions("path")
               .select("rep", "m", "length", "fringe", "tail", "steps", "ends", F.spark_partition_id().cast("long").alias("shard")))
    made = cut_lineage(sorted_.mapInArrow(shard_nodes, SHARD), "trie-shards")

    spines = cut_lineage(made.where("spine").repartition(1).sortWithinPartitions("place").mapInArrow(merged_spines, SHARD), "trie-spines")
    tops = spines.select(F.col("depth").alias("s_depth"), F.col("a").alias("s_a"), F.col("b").alias("s_b"), F.col("conv_id").alias("s_conv"))
    hang = ((F.col("depth") - 1 == F.col("s_depth")) & (F.col("up_a") == F.col("s_a")) & (F.col("up_b") == F.col("s_b")))
    whole = made.where("NOT spine")
    inner = whole.where("parent_conv_id IS NOT NULL")
    hung = (whole.where("parent_conv_id IS NULL").join(bounded_broadcast(tops), hang).withColumn("parent_conv_id", F.col("s_conv")))
    columns = alone.columns
    return alone.unionByName(inner.select(columns)).unionByName(hung.select(columns)).unionByName(spines.select(columns))



#: Nodes are named by the digests of their turns; every node counts in each of its ancestors.
SQL = f"""WITH {CRC_TABLE_SQL}, own AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT conv_id, g, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS place FROM own),
convs AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS donor, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM own)),
given AS (SELECT c.conv_id, n.place AS depth, n.g, n.words FROM convs c JOIN numbered n ON n.conv_id = c.donor AND n.place <= c.h),
turns AS (
  SELECT * FROM given
  UNION ALL
  SELECT n.conv_id, n.place - c.h + coalesce(k.n, 0), n.g, n.words FROM numbered n JOIN convs c ON c.conv_id = n.conv_id
  LEFT JOIN (SELECT conv_id, count(*) AS n FROM given GROUP BY conv_id) k ON k.conv_id = n.conv_id WHERE n.place > c.h),
passed AS (
  SELECT conv_id, depth, words, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs),
stats AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM passed GROUP BY node, depth),
last AS (SELECT conv_id, max_by(node, depth) AS node FROM passed GROUP BY conv_id),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM last GROUP BY node),
below AS (SELECT substr(node, 1, length(node) - 32) AS node, count(*) AS n FROM stats WHERE depth > 0 GROUP BY 1),
counted AS (SELECT s.*, coalesce(b.n, 0) AS n_children FROM stats s LEFT JOIN below b ON b.node = s.node),
sums AS (
  SELECT substr(node, 1, 32 * up) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM counted) GROUP BY 1)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM counted c JOIN sums s ON s.node = c.node LEFT JOIN ends e ON e.node = c.node
LEFT JOIN stats p ON c.depth > 0 AND p.node = substr(c.node, 1, length(c.node) - 32)"""
