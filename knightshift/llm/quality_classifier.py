"""Quality classifier: supervised subword embeddings.

Every word (run of non-blank bytes) and every character n-gram of it hashes to a
row of one embedding table; a word equal to the word before it adds one
further, shared feature.  A document is the average of its feature vectors and
a softmax layer turns it into class probabilities.  Embeddings and output
layer are learned together by numpy stochastic gradient descent, one document
at a time, in one task, on a bounded labelled sample (``max_docs``, ``max_bytes``).

For scoring, the output layer is folded into the table (the logit of an
average is the average of per-feature logits), so a text costs one lookup per
feature.

Edge cases: null, empty and wordless texts get the softmax of the biases, that
is, the share of good documents as learned; repeated rows score alike; null ids
are kept; without any label every score is 0.5; empty tables give empty
results.  Other columns pass through; a column named like the new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_a_task, fit_sample
from .textblocks import Block, blocks, char_ngrams, find_words, hash_words, split_offsets

BITS = 18
DIM = 16
NGRAMS = (2, 4)
REPEAT = 0          # the feature of a word equal to the one before


@dataclass
class Model:
    """Logit of class 1 over class 0: bias + average of ``logit`` over the features."""
    logit: np.ndarray
    bias: float


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a block and the text of each."""
    words = find_words(block)
    shift = np.uint64(64 - BITS)
    hashed = hash_words(block.data, words)
    again = np.flatnonzero((hashed[1:] == hashed[:-1]) & (words.doc[1:] == words.doc[:-1])) + 1
    parts = [np.maximum(hashed >> shift, np.uint64(1)), np.full(len(again), REPEAT, np.uint64)]
    docs = [words.doc, words.doc[again]]
    for n in NGRAMS:
        grams, doc = char_ngrams(block, words.mask, n)
        parts.append(np.maximum(grams >> shift, np.uint64(1)))
        docs.append(doc)
    return np.concatenate(parts).astype(np.int32), np.concatenate(docs)


def train(sample: list[tuple[str, int]], epochs: int = 5, rate: float = 1.0, seed: int = 11) -> Model:
    """Learn table and softmax layer by gradient descent, the rate falling linearly to 0."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2)
    bagged: list[tuple[np.ndarray, np.ndarray, int]] = []
    texts = pa.array([t for t, _ in sample], type=pa.large_string())
    for b in blocks(texts):
        feature, doc = features(b)
        order = np.argsort(doc, kind="stable")
        cut = split_offsets(doc[order], b.n)
        for i in range(b.n):
            ids, count = np.unique(feature[order[cut[i]:cut[i + 1]]], return_counts=True)
            share = (count / max(1, count.sum())).astype(np.float32)
            bagged.append((ids, share, int(sample[b.first + i][1] > 0)))
    steps, done = max(1, epochs * len(bagged)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bagged)):
            ids, share, y = bagged[i]
            now = rate * (1 - done / steps)
            done += 1
            rows = table[ids]
            mean = share @ rows
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1.0                      # gradient of the cross entropy at the logits
            table[ids] = rows - (now * share)[:, None] * (p @ out).astype(np.float32)
            out -= (now * p[:, None] * mean).astype(np.float32)
            bias -= 0.1 * now * p
    return Model((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 8_000, max_bytes: int = 32 << 20) -> Model:
    """Train on a bounded sample of ``labels.quality`` outside the held-out fold."""
    return fit_in_a_task(fit_sample(docs, labels, "quality", max_docs, max_bytes), train)


def score_block(model: Model, block: Block) -> np.ndarray:
    feature, doc = features(block)
    total = np.bincount(doc, weights=model.logit[feature], minlength=block.n)
    count = np.bincount(doc, minlength=block.n)
    z = total / np.maximum(count, 1) + model.bias
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the probability of class 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            done = [score_block(shared.value, b) for b in blocks(col)]
            yield pa.array(np.concatenate(done) if done else np.zeros(0))

    return docs.withColumn(into, judge(F.col(text)))
