"""Quality rules with cross-document line frequency (DataFrame functions only).

Base rules work inside a document: word and symbol counts, repeated lines, words
inside repeated five-word windows.

The line rule works across documents.  Lines are normalised (lower case, blanks
collapsed) and hashed; for each host (here: ``source``) the distinct documents
that hold a line are counted.  A line found in more than ``MIN_DOCS`` documents of
a host, however large the host is, is boilerplate there and is removed; a document
left with less than ``MIN_KEPT`` of its words, or fewer than ``MIN_WORDS``, is
depleted and rejected.  So a page copied to many documents of a host is rejected
with all its copies.  Parameters add a share of the host's documents that a line
must exceed too (0: none), or let documents of equal texts count as one.

The per-document facts (no texts: hashes and counts) are written once.  Documents
per (host, line) are a plain count, reduced in every task.  The lines above the
limits meet the documents' lines again by (host, line): broadcast if they measure
small, else the lines that hold over a hundredth of all rows are broadcast and the
others, none of them hot, are joined by shuffle; words removed are summed by
document.

Edge cases: null, empty and wordless texts have no words and fail the base rule;
a null source is a host of its own; repeated rows are judged alike; null ids are
kept; very long texts are read whole; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knightshift.plans.joins import BROADCAST_BYTES, bounded_broadcast
from knightshift.session import cut_lineage

from .common import BLANKS as BLANK_CHARS
from .common import join_groups

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_DOCS = 10
MAX_SHARE_PERCENT = 0
MIN_KEPT_PERCENT = 30
WORD = r"[^\x20\x09-\x0D]"
BLANKS = r"[\x20\x09-\x0D]+"
ODD_BLANKS = r"[\x09-\x0D]|\x20\x20"
SYMBOL = "[#*$%&|<>]"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def repeated_words(w: Column) -> Column:
    """How many words of ``w`` lie in a five-word window that occurs at least twice."""
    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            again = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(again(x, i), F.get(s, i + 1)["h"] == x["h"], F.get(s, i - 1)["h"] == x["h"], F.lit(False))),
                                            lambda x: x["i"]))

        def reach(p: Column) -> Column:
            step = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        return let(let(ranked, twice), reach)

    def count(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW),
                              lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        return let(windows, lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), 0).otherwise(covered(v)))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes, count))


def facts(docs: DataFrame, id_col: str, text: str, host: str) -> DataFrame:
    """Base counts, a hash of the text and (hash, words) of every line with a word."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = lambda line: F.btrim(line, F.lit(BLANK_CHARS))
    cut = lambda line: F.when(line.rlike(ODD_BLANKS), F.split(line, BLANKS)).otherwise(F.split(line, " "))
    lines = docs.select(F.col(id_col).alias("id"), F.col(host).alias("host"), body.alias("t"),
                        F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)).alias("ls"))
    lines = lines.select("*", F.transform("ls", lambda line: cut(bare(line))).alias("lw"))
    # a word never crosses a line, so the words of the lines are the words of the text
    whole = lines.select("*", F.flatten("lw").alias("w"))
    normal = lambda own: F.lower(F.array_join(own, " "))
    return whole.select(
        "id", "host", F.xxhash64("t").alias("doc"), F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("t", SYMBOL)) - 1).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.transform("lw", lambda own: F.struct(F.xxhash64(normal(own)).alias("h"), F.size(own).alias("k"))).alias("lines"))


def boilerplate(own: DataFrame, min_docs: int = MIN_DOCS, max_share_percent: int = MAX_SHARE_PERCENT, fold_equal: bool = False) -> DataFrame:
    """Rows (of, line, n, rows): the lines above the limits of each host, the documents that hold them, and their rows."""
    held = own.select("host", "doc", F.explode(F.array_distinct("lines.h")).alias("h"))
    n = F.count_distinct("doc") if fold_equal else F.count(F.lit(1))
    lines = held.groupBy("host", "h").agg(n.alias("n"), F.count(F.lit(1)).alias("rows")).where(F.col("n") > min_docs)
    if max_share_percent:
        size = own.groupBy(F.col("host").alias("__h")).agg((F.count_distinct("doc") if fold_equal else F.count(F.lit(1))).alias("docs"))
        lines = (lines.join(bounded_broadcast(size), F.col("host").eqNullSafe(F.col("__h")))
                 .where(F.col("n") * 100 > F.col("docs") * max_share_percent))
    return lines.select(F.col("host").alias("of"), F.col("h").alias("line"), "n", "rows")


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS,
          max_share_percent: int = MAX_SHARE_PERCENT, min_kept_percent: int = MIN_KEPT_PERCENT, fold_equal: bool = False,
          max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, removed_words and kept."""
    own = cut_lineage(facts(docs, id_col, text, host).withColumn("row", F.monotonically_increasing_id()), "line-facts")
    frequent = cut_lineage(boilerplate(own, min_docs, max_share_percent, fold_equal), "frequent-lines")
    lines = own.select("row", "host", F.inline("lines"))
    same = F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line"))
    total = own.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    gone = (join_groups(lines, frequent, same, "line", "rows", total, max_bytes)
            .groupBy(F.col("row").alias("__row")).agg(F.sum("k").alias("gone")))
    joined = own.join(gone, F.col("row") == F.col("__row"), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left * 100 < F.col("n_words") * min_kept_percent) | (left < MIN_WORDS)
    return (joined.withColumn("removed_words", F.coalesce("gone", F.lit(0)).cast("long")).withColumn("base_failed", failed)
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ~depleted).alias("kept"), "removed_words"))


SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{WORD}+') AS ws FROM d),
wd AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) >= {WINDOW}),
five AS (SELECT rid, i, x || {' || '.join(f"' ' || lead(x, {k}) OVER v" for k in range(1, WINDOW))} AS g FROM wd WINDOW v AS (PARTITION BY rid ORDER BY i)),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM five WHERE g IS NOT NULL),
rep AS (SELECT rid, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, {WINDOW})) AS k FROM win WHERE n > 1),
reps AS (SELECT rid, sum(k) AS k FROM rep GROUP BY rid),
raw AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT rid, line, regexp_replace(lower(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS h
  FROM raw WHERE regexp_matches(line, '{WORD}')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS k FROM ln GROUP BY rid),
held AS (SELECT source, h, count(DISTINCT rid) AS n FROM ln JOIN d USING (rid) GROUP BY source, h),
freq AS (SELECT source, h FROM held WHERE n > {MIN_DOCS}),
gone AS (SELECT rid, sum(len(regexp_extract_all(h, '{WORD}+'))) AS k FROM ln JOIN d USING (rid)
  WHERE EXISTS (SELECT 1 FROM freq WHERE freq.source IS NOT DISTINCT FROM d.source AND freq.h = ln.h) GROUP BY rid),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '{SYMBOL}'))::BIGINT AS n_symbols, coalesce(dup.k, 0)::BIGINT AS n_dup_lines,
  coalesce(reps.k, 0)::BIGINT AS n_repeat_words, coalesce(gone.k, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (rid) LEFT JOIN reps USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
c AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed,
  (n_words - removed_words) * 100 < n_words * {MIN_KEPT_PERCENT} OR n_words - removed_words < {MIN_WORDS} AS depleted FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, removed_words FROM c"""
