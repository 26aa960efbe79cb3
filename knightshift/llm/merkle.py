"""Merkle manifest of a dataset: one root for all rows, a proof for each.

Every row is a leaf, the hash of its framed columns.  The leaves of a group
(here a language), in id order, are hashed in runs of eight to the group's
subroot; the subroots, in group order, are hashed the same way to the root.

A level is one pass of lag/lead windows: the nodes of a group are cut into
blocks of ``BLOCK`` positions (a multiple of the run), so a group of any size
spreads over the cluster; fixed-offset ``lag`` and ``lead`` columns, masked by
the slot of a node in its run and by the run's length, hold its siblings, and
the row of the first child hashes the parent.  The next level has an eighth of
the rows; the number of passes is the logarithm of the largest group.

Proofs go the other way: each level joins its parents' (left, right) sibling
texts on (group, run), so a leaf ends with the path to the root and folds it
without another look at the tree.  Positions come from balanced numbering
(``running_totals``); nothing is collected.

Edge cases: a null column enters a leaf as ``-``; a null group stands before
all others; null ids stand first in their group, rows of equal id in the order
of their leaf, and repeated rows are leaves of their own; empty and very long
texts are hashed whole; a group of one leaf has that leaf as subroot; an empty
table has no root and gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knightshift.operators.ordered import running_totals
from knightshift.session import cut_lineage

from .common import CRC_TABLE_SQL, crc32_sql

ARITY = 8
BLOCK = ARITY ** 4          # positions of one window partition
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


@dataclass
class Climb:
    """Levels of nodes (grp, pos, h, left, right, lone) from the leaves up, and the last nodes (grp, h)."""
    levels: list[DataFrame]
    tops: DataFrame


@dataclass
class Manifest:
    groups: Climb
    whole: Climb


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return digest(F.concat(*[framed(c) for c in columns]))


def group_key(group: Column) -> Column:
    """A text that orders groups by their UTF-8 bytes, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def level_of(nodes: DataFrame) -> DataFrame:
    """Adds to nodes (grp, pos, h, ...) the siblings' hashes on both sides, ``lone`` and, at first children, the parent."""
    pos = F.col("pos")
    block, slot = F.expr(f"pos div {BLOCK}"), pos % ARITY
    part = Window.partitionBy("grp", "block")
    in_order = part.orderBy("pos")
    run = F.least(F.lit(ARITY), F.col("in_block") - (pos % BLOCK - slot))
    left = [F.when(slot >= k, F.lag("h", k).over(in_order)) for k in range(ARITY - 1, 0, -1)]
    right = [F.when(slot + k < F.col("run"), F.lead("h", k).over(in_order)) for k in range(1, ARITY)]
    lone = (F.col("block") == 0) & (F.col("in_block") == 1)
    sided = (nodes.withColumn("block", block)
             .withColumn("in_block", F.count(F.lit(1)).over(part)).withColumn("run", run)
             .select(*nodes.columns, F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"), lone.alias("lone")))
    parent = F.when(F.col("lone"), F.col("h")).otherwise(digest(F.concat("h", "right")))
    return sided.withColumn("parent", F.when(slot == 0, parent))


def climb(nodes: DataFrame, name: str) -> Climb:
    """All levels over nodes (grp, pos, h, ...): each is written, the next reads its first children."""
    levels = []
    while True:
        level = cut_lineage(level_of(nodes), f"merkle-{name}")
        levels.append(level)
        nodes = level.where(F.col("parent").isNotNull()).select("grp", F.expr(f"pos div {ARITY}").alias("pos"), F.col("parent").alias("h"))
        if nodes.where("pos > 0").limit(1).count() == 0:       # every group is down to one node
            return Climb(levels, nodes.select("grp", "h"))


def build(leaves: DataFrame, order_by: list[str]) -> Manifest:
    """The tree over leaves (grp, h, further columns), ordered by ``order_by`` inside each group."""
    placed = running_totals(leaves, ["grp"], order_by, row_number="place")
    groups = climb(placed.withColumn("pos", F.col("place") - 1).drop("place"), "leaves")
    subroots = groups.tops.select(F.lit("").alias("grp"), F.col("grp").alias("member"), "h")
    ranked = running_totals(subroots, ["grp"], ["member"], row_number="place")
    return Manifest(groups, climb(ranked.withColumn("pos", F.col("place") - 1).drop("place"), "subroots"))


def paths(done: Climb, above: DataFrame) -> DataFrame:
    """The leaves of ``done`` with ``path``, their siblings level by level.

    ``above`` gives for each group (grp) the path beyond its top node, and columns to hand down.
    """
    handed = [c for c in above.columns if c not in ("grp", "path")]
    upper = above.withColumn("pos", F.lit(0).cast("long"))
    for k, level in reversed(list(enumerate(done.levels))):
        parents = upper.select(F.col("grp").alias("p_grp"), F.col("pos").alias("p_pos"), "path", *handed)
        step = F.when(F.col("lone"), F.array().cast(PATH)).otherwise(F.array(F.struct("left", "right")))
        kept = [c for c in level.columns if c not in ("left", "right", "lone", "parent", "h" if k else "")]
        upper = (level.join(parents, (F.col("grp") == F.col("p_grp")) & (F.expr(f"pos div {ARITY}") == F.col("p_pos")))
                 .select(*kept, F.concat(step, "path").alias("path"), *handed))
    return upper


def prove(tree: Manifest) -> DataFrame:
    """The leaves with their further columns, ``subroot``, ``root`` and the ``path`` of siblings up to the root."""
    root = tree.whole.tops.select("grp", F.col("h").alias("root"), F.array().cast(PATH).alias("path"))
    of_groups = paths(tree.whole, root)
    above = of_groups.select(F.col("member").alias("grp"), "path", F.col("h").alias("subroot"), "root")
    return paths(tree.groups, above)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf hash and its path of siblings lead to."""
    return F.aggregate(path, leaf, lambda h, side: digest(F.concat(side["left"], h, side["right"])))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), ""))


def nodes(tree: Manifest) -> DataFrame:
    """Every node of the manifest: tree (``group`` or ``whole``), level, grp, pos, h."""
    out = None
    for name, part in (("group", tree.groups), ("whole", tree.whole)):
        for k, level in enumerate(part.levels):
            rows = level.select(F.lit(name).alias("tree"), F.lit(k).alias("level"), "grp", "pos", "h")
            out = rows if out is None else out.unionByName(rows)
    return out


def audit(docs: DataFrame, changed: Column, id_col: str = "doc_id", group: str = "lang", text: str = "text",
          columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Build the manifest of ``docs`` and check every row, its text replaced by ``changed``, against it.

    Returns id, leaf, subroot, root and proof_sha256 of the stored rows, folded_root and verified of the changed ones.
    """
    stored = [F.col(c) for c in columns]
    tampered = [changed if c == text else F.col(c) for c in columns]
    leaves = docs.select(group_key(F.col(group)).alias("grp"), F.col(id_col).alias("__id"),
                         leaf_hash(stored).alias("h"), leaf_hash(tampered).alias("changed"))
    proved = prove(build(leaves, ["__id", "h"]))
    out = proved.select(F.col("__id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root",
                        proof_hash(F.col("path")).alias("proof_sha256"), fold(F.col("path"), F.col("changed")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def small_letters(text: Column) -> Column:
    """Only A-Z lower-cased."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


#: One pass per level as a recursive table; each further table folds or lists a leaf's path.
SQL = f"""WITH RECURSIVE {CRC_TABLE_SQL}, framed AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    sha256(head || coalesce(strlen(small) || ':' || small, '-')) AS c FROM framed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
low(lvl, lang, pos, n, h) AS (
  SELECT 0, lang, pos, n, h FROM placed
  UNION ALL
  SELECT lvl + 1, lang, pos // {ARITY}, max((n + {ARITY - 1}) // {ARITY}), sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1
  GROUP BY lvl, lang, pos // {ARITY}),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // {ARITY}, max((n + {ARITY - 1}) // {ARITY}), sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1
  GROUP BY lvl, pos // {ARITY}),
low_sides AS (
  SELECT lvl, lang, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM low WHERE n > 1 WINDOW w AS (PARTITION BY lvl, lang, pos // {ARITY} ORDER BY pos)),
high_sides AS (
  SELECT lvl, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM high WHERE n > 1 WINDOW w AS (PARTITION BY lvl, pos // {ARITY} ORDER BY pos)),
start AS (
  SELECT row_number() OVER () AS leaf_no, p.doc_id, p.lang, p.h AS leaf, s.subroot, s.pos AS s_pos, p.pos,
    CASE WHEN {crc32_sql("CAST(p.doc_id AS VARCHAR)")} % 3 = 0 THEN p.c ELSE p.h END AS acc
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang),
walk(leaf_no, lang, s_pos, side, lvl, pos, acc, proof) AS (
  SELECT leaf_no, lang, s_pos, 0, 0, pos, acc, '' FROM start
  UNION ALL
  SELECT w.leaf_no, w.lang, w.s_pos,
    CASE WHEN w.side = 0 AND a.lvl IS NULL THEN 1 WHEN w.side = 1 AND b.lvl IS NULL THEN 2 ELSE w.side END,
    CASE WHEN w.side = 0 AND a.lvl IS NULL THEN 0 ELSE w.lvl + 1 END,
    CASE WHEN w.side = 0 AND a.lvl IS NULL THEN w.s_pos WHEN w.side = 1 AND b.lvl IS NULL THEN 0 ELSE w.pos // {ARITY} END,
    CASE WHEN a.lvl IS NOT NULL THEN sha256(a.l || w.acc || a.r) WHEN b.lvl IS NOT NULL THEN sha256(b.l || w.acc || b.r) ELSE w.acc END,
    w.proof || coalesce(a.l || a.r, '') || coalesce(b.l || b.r, '')
  FROM walk w LEFT JOIN low_sides a ON w.side = 0 AND a.lvl = w.lvl AND a.lang IS NOT DISTINCT FROM w.lang AND a.pos = w.pos
  LEFT JOIN high_sides b ON w.side = 1 AND b.lvl = w.lvl AND b.pos = w.pos
  WHERE w.side < 2)
SELECT s.doc_id, s.leaf, s.subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = t.h AS verified
FROM start s JOIN walk w ON w.leaf_no = s.leaf_no AND w.side = 2, (SELECT h FROM high WHERE n = 1) t"""
