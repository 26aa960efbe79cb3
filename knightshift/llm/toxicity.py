"""Toxicity by multiple-instance learning.

A document is a bag of sentences (pieces of at most ``MAX_WORDS`` words between
``.``, ``!``, ``?`` and line ends).  A sentence's score is the logistic of a
bias plus the weights of its lower-cased hashed words and byte n-grams; the
document's score is the noisy-or of its sentences, 1 - prod(1 - p).  Only
document labels are needed: the gradient of the noisy-or tells each sentence
how much of its document's label it has to explain, so the trained sentence
scores also point to the offending sentences.

Training runs in numpy, in one task, on a bounded labelled sample (``max_docs``,
``max_bytes``); scoring runs over every whole text in Arrow batches.

Edge cases: null, empty and wordless texts score 0 and have no offending
sentence; repeated rows score alike; null ids are kept; without any label the
model is the bias alone, so every score is near 0; empty tables give empty
results.  Other columns pass through; a column named like a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fit_in_a_task, fit_sample
from .textblocks import ALNUM, LOWER, SENTENCE_END, Block, Words, blocks, byte_ngrams, find_words, hash_words

BITS = 18
NGRAM = 5
MAX_WORDS = 32
START_BIAS = -5.0
SPANS = "array<struct<start:int,end:int,score:double>>"


@dataclass
class Model:
    weight: np.ndarray
    bias: float


@dataclass
class Bags:
    """Features of a block: unit of each feature, text of each unit, first and last word of each unit."""
    feature: np.ndarray
    unit: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    words: Words | None


def sentences(block: Block, words: Words) -> np.ndarray:
    """Sentence unit of each word, counted through the block."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    ended = np.cumsum(SENTENCE_END[block.data])[words.start]
    new = np.ones(len(words.start), dtype=bool)
    new[1:] = (ended[1:] != ended[:-1]) | (words.doc[1:] != words.doc[:-1])
    at = np.arange(len(new))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    new |= rank % MAX_WORDS == 0
    return np.cumsum(new) - 1


def bags(block: Block) -> Bags:
    lower = LOWER[block.data]
    words = find_words(block, ALNUM)
    unit = sentences(block, words)
    shift = np.uint64(64 - BITS)
    hashed = hash_words(lower, words)
    fresh = np.ones(len(hashed), dtype=bool)          # a run of one repeated word counts once
    fresh[1:] = (hashed[1:] != hashed[:-1]) | (unit[1:] != unit[:-1])
    grams, at = byte_ngrams(lower, block.offsets, words.mask, NGRAM)
    begins = np.zeros(len(block.data) + 1, dtype=np.int64)
    begins[words.start] = 1
    word_of = (np.cumsum(begins) - 1)[at + 1] if len(at) else np.zeros(0, np.int64)
    used = fresh[word_of] if len(at) else np.zeros(0, bool)
    feature = np.concatenate((hashed[fresh] >> shift, grams[used] >> shift)).astype(np.int64)
    units = np.concatenate((unit[fresh], unit[word_of[used]]))
    first = np.flatnonzero(np.diff(unit, prepend=-1)) if len(unit) else np.zeros(0, np.int64)
    return Bags(feature, units, words.doc[first], first, words)


@dataclass
class Lean:
    """What training needs of the bags of a block, small: features by unit, how many each unit has, and its text."""
    feature: np.ndarray
    each: np.ndarray
    doc: np.ndarray

    @property
    def unit(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.each)), self.each)


def lean(bag: Bags) -> Lean:
    order = np.argsort(bag.unit, kind="stable")
    return Lean(bag.feature[order].astype(np.int32), np.bincount(bag.unit, minlength=len(bag.doc)).astype(np.int32), bag.doc.astype(np.int32))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def unit_scores(model: Model, bag: Bags | Lean) -> np.ndarray:
    z = np.bincount(bag.unit, weights=model.weight[bag.feature], minlength=len(bag.doc))
    return _sigmoid(z + model.bias)


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    none = np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n)
    return -np.expm1(none)


def train(sample: list[tuple[str, int]], epochs: int = 10, rate: float = 0.3, l1: float = 5e-4,
          batch_bytes: int = 1 << 18, least_batches: int = 64, seed: int = 5) -> Model:
    """Fit sentence weights to document labels by mini-batch Adagrad on the noisy-or likelihood.

    ``l1`` shrinks every weight a little at each step, so that only features which keep explaining labels
    stay.  An eighth of the sample is set aside to choose the shift of the bias by F1.
    """
    model = Model(np.zeros(1 << BITS), START_BIAS)
    if not sample:
        return model
    aside, sample = sample[::8], [x for i, x in enumerate(sample) if i % 8] or sample
    order = np.random.default_rng(seed).permutation(len(sample))
    labels = np.array([sample[i][1] for i in order], dtype=float)
    texts = pa.array([sample[i][0] for i in order], type=pa.large_string())
    size = max(1, min(batch_bytes, sum(len(t) for t, _ in sample) // least_batches))
    batches = [(lean(bags(b)), labels[b.first:b.first + b.n], b.n) for b in blocks(texts, size)]
    squares, bias_square = np.full(1 << BITS, 1e-3), 1e-3
    for epoch in range(epochs):
        for k in np.random.default_rng(seed + epoch).permutation(len(batches)):
            bag, y, n = batches[k]
            p = unit_scores(model, bag)
            whole = np.clip(noisy_or(p, bag.doc, n), 1e-9, 1)
            push = np.where(y > 0, -(1 - whole) / whole, 1.0)[bag.doc] * p / n
            grad = np.bincount(bag.feature, weights=push[bag.unit], minlength=1 << BITS)
            squares += grad * grad
            model.weight -= rate * grad / np.sqrt(squares)
            model.weight = np.sign(model.weight) * np.maximum(np.abs(model.weight) - l1, 0)
            bias_square += push.sum() ** 2
            model.bias -= rate * push.sum() / np.sqrt(bias_square)
    model.weight = model.weight.astype(np.float32)
    model.bias += best_shift(model, aside)
    return model


def best_shift(model: Model, sample: list[tuple[str, int]]) -> float:
    """The shift of the bias, from 0 to 1.5, at which scores of 0.5 or more agree best with the labels (F1)."""
    y = np.array([label for _, label in sample]) > 0
    texts = pa.array([text for text, _ in sample], type=pa.large_string())
    bagged = [(lean(bags(b)), b.n) for b in blocks(texts)]
    best, found = 0.0, -1.0
    for shift in np.arange(0, 1.75, 0.25):
        moved = Model(model.weight, model.bias + shift)
        said = np.concatenate([noisy_or(unit_scores(moved, bag), bag.doc, n) for bag, n in bagged]) >= 0.5
        f1 = 2 * (said & y).sum() / max(1, said.sum() + y.sum())
        if f1 > found:
            best, found = float(shift), f1
    return best


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 8_000, max_bytes: int = 32 << 20) -> Model:
    """Train on a bounded sample of ``labels.toxic`` outside the held-out fold."""
    return fit_in_a_task(fit_sample(docs, labels, "toxic", max_docs, max_bytes), train)


def score_block(model: Model, block: Block, limit: float) -> tuple[np.ndarray, list[list[dict]]]:
    bag = bags(block)
    p = unit_scores(model, bag)
    spans: list[list[dict]] = [[] for _ in range(block.n)]
    hot = np.flatnonzero(p >= limit)
    if len(hot):
        chars = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
        last = np.append(bag.first[1:], len(bag.words.start)) - 1
        for u in hot:
            a, z, d = bag.first[u], last[u], bag.doc[u]
            base = chars[block.offsets[d]]
            end = bag.words.start[z] + bag.words.length[z]
            spans[d].append({"start": int(chars[bag.words.start[a]] - base), "end": int(chars[end] - base),
                             "score": float(p[u])})
    return noisy_or(p, bag.doc, block.n), spans


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score", spans: str | None = "offending",
          limit: float = 0.5) -> DataFrame:
    """Add the document score and, unless ``spans`` is None, the sentences scoring ``limit`` or
    more (code-point offsets, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,spans:" + SPANS + ">")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for col in batches:
            done = [score_block(shared.value, b, limit) for b in blocks(col)]
            scores = np.concatenate([d[0] for d in done]) if done else np.zeros(0)
            found = pa.array([s for d in done for s in d[1]], type=kind)
            yield pa.StructArray.from_arrays([pa.array(scores), found], names=["score", "spans"])

    own = "__judged"
    out = docs.withColumn(own, judge(F.col(text))).withColumn(into, F.col(f"{own}.score"))
    if spans:
        out = out.withColumn(spans, F.col(f"{own}.spans"))
    return out.drop(own)


def clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The documents whose score is below ``limit``, columns unchanged."""
    scored = score(docs, fit(docs, labels), into="__toxic", spans=None)
    return scored.where(F.col("__toxic") < limit).drop("__toxic")
