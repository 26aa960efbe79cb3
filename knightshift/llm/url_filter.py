"""URL filter: allow and block rules, and gradient-boosted trees where no rule fits.

A rule names a host, with all its subdomains, and the start of a path; of the
rules that fit, the longest (host and path together) wins, of equally long ones
the first listed.  A URL that no rule fits is judged by boosted trees on its
lexical features: lengths, depth, digit ratios, entropies, parameter and hyphen
counts, and statistics of the host's suffix (its last two labels) over the whole
table: URLs, distinct hosts and the smoothed blocked share of labelled URLs.

The trees are histogram trees fitted by Newton steps of the logistic loss, in
numpy, on the features of at most ``max_urls`` distinct labelled URLs (a seeded
sample by URL hash, so the URLs themselves never travel); an eighth of them is
set aside to choose the number of trees.  Suffix statistics are grouped counts
over all rows; they return to the rows by a broadcast if they measure small.
Beyond that, the suffixes with over a hundredth of all rows (a hundred at most)
are still broadcast, and the others, none of them hot, are joined by shuffle.

Edge cases: a null URL and one without ``://`` have an empty host and path, fit
no rule and are scored like any other; empty and very long URLs are read whole;
repeated rows are judged alike; null ids stay; without labelled URLs every score
is 0.5 and nothing is blocked (a URL is blocked above 0.5); an empty table gives
an empty result.  Other columns pass through ``judge``; one named like
a new column (host, path, rule, score, verdict) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knightshift.plans.joins import BROADCAST_BYTES
from knightshift.session import cut_lineage

from .common import join_groups
from .textblocks import blocks, byte_table, text_buffers

#: Fixed values: (verdict, host, start of the path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "url_digits", "host_digits", "hyphens",
            "url_entropy", "host_entropy", "parameters", "suffix_urls", "suffix_hosts", "suffix_blocked")
PRIOR_WEIGHT = 20           # labelled URLs that the overall blocked share counts for in a suffix
BINS = 64
_DIGIT, _SLASH, _DOT, _HYPHEN, _AMP = (byte_table(b) for b in (b"0123456789", b"/", b".", b"-", b"&"))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty if there is none."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), letters, letters.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Text of the longest rule that fits, or null."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return F.coalesce(*[F.when(fits(h, p), F.lit(h + p)) for _, h, p in longest], F.lit(None).cast("string"))


def verdict_of(rule: Column, rules=RULES) -> Column:
    return F.coalesce(*[F.when(rule == h + p, F.lit(v)) for v, h, p in rules], F.lit(None).cast("string"))


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    so_far = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return (so_far[offsets[1:]] - so_far[offsets[:-1]]).astype(float)


def _entropy(col: pa.Array) -> np.ndarray:
    """Bits of Shannon entropy of each text's bytes."""
    out = [np.zeros(0)]
    for b in blocks(col, 1 << 16):
        row = np.repeat(np.arange(b.n), np.diff(b.offsets))
        n = np.bincount(row * 256 + b.data, minlength=b.n * 256).reshape(b.n, 256).astype(float)
        total = np.maximum(n.sum(axis=1, keepdims=True), 1)
        p = n / total
        out.append(-(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1))
    return np.concatenate(out)


def features(url: pa.Array, host: pa.Array, path: pa.Array, query: pa.Array, urls: pa.Array, hosts: pa.Array, blocked: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` a URL."""
    data, size, n = {}, {}, {}
    for name, col in (("url", url), ("host", host), ("path", path), ("query", query)):
        raw, offsets = text_buffers(col)
        data[name] = (raw[offsets[0]:offsets[-1]], offsets - offsets[0])
        size[name] = np.diff(offsets).astype(float)
    for name, part, mask in (("depth", "path", _SLASH), ("dots", "host", _DOT), ("url_digits", "url", _DIGIT), ("host_digits", "host", _DIGIT),
                             ("hyphens", "host", _HYPHEN), ("ands", "query", _AMP)):
        raw, offsets = data[part]
        n[name] = _count(mask[raw], offsets)
    return np.column_stack([
        size["url"], size["host"], size["path"], n["depth"], np.where(size["host"] > 0, n["dots"] + 1, 0),
        n["url_digits"] / np.maximum(size["url"], 1), n["host_digits"] / np.maximum(size["host"], 1), n["hyphens"],
        _entropy(url), _entropy(host), np.where(size["query"] > 0, n["ands"] + 1, 0),
        np.log1p(urls.to_numpy(zero_copy_only=False).astype(float)), np.log1p(hosts.to_numpy(zero_copy_only=False).astype(float)),
        blocked.to_numpy(zero_copy_only=False).astype(float)])


@dataclass
class Tree:
    """A complete binary tree: split feature and upper limit of each inner node, value of each leaf."""
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(len(self.value).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[at]] > self.limit[at])
        return at - len(self.feature)


@dataclass
class Model:
    bias: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for t in self.trees:
            z += t.value[t.leaf(x)]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _bins(x: np.ndarray) -> list[np.ndarray]:
    """Upper limits of the bins of each feature, by quantiles of its distinct values."""
    cuts = []
    for k in range(x.shape[1]):
        seen = np.unique(x[:, k])
        middle = (seen[1:] + seen[:-1]) / 2
        cuts.append(middle if len(middle) < BINS else np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])))
    return cuts


def grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float) -> Tree:
    """One tree: at each level every node takes the split of the largest gain in the histograms of its gradients."""
    inner = (1 << depth) - 1
    feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
    at = np.zeros(len(grad), np.int64)
    rows = np.arange(len(grad))
    for level in range(depth):
        first, width = (1 << level) - 1, 1 << level
        best = np.full(width, 1e-9)
        node = at - first
        split = np.full(width, BINS)
        for k, limits in enumerate(cuts):
            if not len(limits):
                continue
            cell = node * (BINS + 1) + binned[:, k]
            g, h = (np.bincount(cell, weights=w, minlength=width * (BINS + 1)).reshape(width, BINS + 1) for w in (grad, hess))
            gl, hl = np.cumsum(g, axis=1)[:, :len(limits)], np.cumsum(h, axis=1)[:, :len(limits)]
            gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
            gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
            top = gain.argmax(axis=1)
            better = np.flatnonzero(gain[np.arange(width), top] > best)
            best[better] = gain[better, top[better]]
            feature[first + better], limit[first + better], split[better] = k, limits[top[better]], top[better]
        at = 2 * at + 1 + (binned[rows, feature[at]] > split[node])
    leaf = at - inner
    g, h = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (grad, hess))
    return Tree(feature, limit, -g / (h + ridge))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.2, ridge: float = 1.0) -> Model:
    """Boost trees on all rows but every eighth; keep as many as serve those best (log loss)."""
    if not len(y):
        return Model()
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Model(float(np.log(share / (1 - share))))
    kept = np.arange(len(y)) % 8 != 0 if len(y) >= 16 else np.ones(len(y), bool)
    own, label = x[kept], y[kept]
    cuts = _bins(own)
    binned = np.column_stack([np.searchsorted(c, own[:, k], side="left") for k, c in enumerate(cuts)])
    z, aside, trees = np.full(len(label), model.bias), np.full(int((~kept).sum()), model.bias), []
    losses = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = grow(binned, cuts, p - label, p * (1 - p), depth, ridge)
        tree.value *= rate
        trees.append(tree)
        z += tree.value[tree.leaf(own)]
        aside += tree.value[tree.leaf(x[~kept])]
        losses.append(float(np.logaddexp(0, np.where(y[~kept] > 0, -aside, aside)).sum()))
    model.trees = trees[:int(np.argmin(losses)) + 1] if len(aside) else trees
    return model


def described(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, and the parts the features need (``__query``, ``__suffix``)."""
    out = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    labels = F.split("host", r"\.")
    return (out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
            .withColumn("__query", F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1))
            .withColumn("__suffix", F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))))


def suffix_statistics(pages: DataFrame, labelled: Column) -> DataFrame:
    """URLs, distinct hosts, labelled and blocked URLs of each suffix; ``labelled`` is 1 (block), 0 (allow) or null."""
    by_host = pages.groupBy("__suffix", "host").agg(F.count(F.lit(1)).alias("urls"), F.count(labelled).alias("known"), F.sum(labelled).alias("bad"))
    return by_host.groupBy("__suffix").agg(F.sum("urls").alias("__urls"), F.count(F.lit(1)).alias("__hosts"),
                                           F.sum("known").alias("__known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("__bad"))


def with_statistics(pages: DataFrame, stats: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``__urls``, ``__hosts`` and ``__share`` of the suffix."""
    total = stats.agg(F.sum("__urls"), F.sum("__known"), F.sum("__bad")).first()
    overall = total[2] / total[1] if total[1] else 0.5
    share = (F.col("__bad") + PRIOR_WEIGHT * overall) / (F.col("__known") + PRIOR_WEIGHT)
    known = stats.select(F.col("__suffix").alias("__s"), "__urls", "__hosts", share.alias("__share"))
    return join_groups(pages, known, F.col("__suffix") == F.col("__s"), "__s", "__urls", total[0] or 0, max_bytes).drop("__s")


INPUTS = ("host", "path", "__query", "__urls", "__hosts", "__share")


def fit(pages: DataFrame, label: str, url: str = "url", max_urls: int = 20_000) -> Model:
    """Train on a bounded, seeded sample of the distinct URLs of ``pages`` (with statistics) whose ``label`` is not null."""
    labelled = pages.where(F.col(label).isNotNull() & F.col(url).isNotNull())
    n = labelled.count()
    order = F.pmod(F.xxhash64(F.col(url), F.lit(23)), F.lit(1 << 40))
    chosen = (labelled.where(order < int((1 << 40) * min(1.0, max_urls / max(n, 1))))
              .groupBy(url).agg(F.max(F.col(label).cast("int")).alias("__y"), *[F.first(c).alias(c) for c in INPUTS])
              .orderBy(order, url).limit(max_urls))

    @F.arrow_udf("array<double>")
    def lexical(u: pa.Array, h: pa.Array, p: pa.Array, q: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array(list(features(u, h, p, q, a, b, c)), type=pa.list_(pa.float64()))

    rows = chosen.select(F.xxhash64(F.col(url), F.lit(29)).alias("k"), lexical(F.col(url), *INPUTS).alias("x"), "__y").collect()
    rows.sort(key=lambda r: (r["k"], r["x"]))
    return train(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["__y"] for r in rows], dtype=float))


def score(pages: DataFrame, model: Model, url: str = "url", into: str = "score") -> DataFrame:
    """Add the model's score to pages with statistics."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judged(u: pa.Array, h: pa.Array, p: pa.Array, q: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(features(u, h, p, q, a, b, c)))

    return pages.withColumn(into, judged(F.col(url), *INPUTS))


def judge(pages: DataFrame, url: str = "url", rules=RULES, labels: Column | None = None, max_urls: int = 20_000) -> DataFrame:
    """Adds host, path, rule, score and verdict.

    The trees learn from ``labels`` (1 block, 0 allow, null unknown); by default from the URLs that a rule settles.
    """
    parts = described(pages, url, rules)
    ruled = verdict_of(F.col("rule"), rules)
    known = (ruled == "block").cast("int") if labels is None else labels.cast("int")
    marked = parts.withColumn("__label", known)
    ready = with_statistics(marked, cut_lineage(suffix_statistics(marked, F.col("__label")), "suffixes"))
    scored = score(ready, fit(ready, "__label", url, max_urls), url)
    learned = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce(ruled, learned)).drop("__label", "__query", "__suffix", "__urls", "__hosts", "__share")
