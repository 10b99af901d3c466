"""Document quality from a byte-level convolutional network in numpy.

Filters of a few bytes slide over the whole document. Their responses are
max-pooled within chunks that overlap by half; over the chunks, the largest and
the mean of these maxima give two features per filter, which one logistic unit
combines into the probability of label 1. Embedding and filter are merged: a
filter is a table of one weight per offset and byte.

Training is gradient descent on a bounded sample of the labelled training rows
(``max_rows`` rows, those with the smallest hash of doc_id, and at most
``max_bytes`` bytes of text). Scoring covers every byte of every document and
runs as one narrow Arrow UDF; the network is about 200 KB.

Edge cases: null and empty texts are one chunk of padding and get a score like
any other; with no labelled row the score is 0.5 everywhere, and with labels of
one class alone it is that class's smoothed share. Null doc_ids are never
training rows. Repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubewash.llm.common import doc_groups, text_bytes, training_fold

WIDTH = 6  # bytes under a filter
STRIDE = 2  # bytes between filter positions
BLOCK = 64  # positions of half a chunk; chunks are two neighbouring blocks
FILTERS = 16
PAD = 256  # symbol of the padding after a text


@dataclass
class ByteCnn:
    tables: np.ndarray  # (WIDTH, 257, FILTERS) float32; the padding's weights stay 0
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,): of the largest and of the mean chunk maximum
    offset: float

    def responses(self, data: np.ndarray, offsets: np.ndarray):
        """Filter responses by block: (blocks, BLOCK, FILTERS) and each document's first block."""
        lengths = np.diff(offsets)
        blocks = np.maximum(1, -(-lengths // (STRIDE * BLOCK)))
        first = np.concatenate([[0], np.cumsum(blocks)])
        padded = np.full(first[-1] * STRIDE * BLOCK + WIDTH, PAD, np.int32)
        # bytes of a document start at its first block; the rest of its last block is padding
        shift = np.repeat(first[:-1] * STRIDE * BLOCK - offsets[:-1], lengths)
        padded[np.arange(len(data)) + shift] = data
        out = np.broadcast_to(self.bias, (first[-1] * BLOCK, FILTERS)).copy()
        for j in range(WIDTH):
            out += self.tables[j].take(padded[j:j + first[-1] * STRIDE * BLOCK:STRIDE], axis=0)
        return out.reshape(-1, BLOCK, FILTERS), first, padded

    @staticmethod
    def pool(block_max: np.ndarray, first: np.ndarray):
        """Largest and mean of the chunk maxima of each document, after the rectifier."""
        block_max = np.maximum(block_max, 0)
        chunk = block_max.copy()
        chunk[:-1] = np.maximum(chunk[:-1], block_max[1:])
        last = first[1:] - 1  # a document's last block has no right neighbour of its own
        chunk[last] = block_max[last]
        counts = np.diff(first)[:, None]
        return np.maximum.reduceat(chunk, first[:-1]), np.add.reduceat(chunk, first[:-1]) / counts

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for i, j in doc_groups(offsets, 1 << 16):  # work arrays stay in the cache
            response, first, _ = self.responses(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            top, mean = self.pool(response.max(axis=1), first)
            z = np.concatenate([top, mean], axis=1).astype(np.float64) @ self.weights + self.offset
            out[i:j] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def _prior(share: float) -> ByteCnn:
    logit = float(np.log(share / (1 - share)))
    return ByteCnn(np.zeros((WIDTH, 257, FILTERS), np.float32), np.zeros(FILTERS, np.float32),
                   np.zeros(2 * FILTERS), logit)


def fit(texts: list[str | None], labels: list[int], epochs: int = 12, batch: int = 32,
        seed: int = 7) -> ByteCnn:
    """Adam on the logistic loss. Gradients pass the max-pools to the positions that won."""
    labels_ = np.asarray(labels, np.float64)
    if len(labels_) == 0:
        return _prior(0.5)
    if labels_.min() == labels_.max():
        return _prior((labels_.sum() + 1) / (len(labels_) + 2))
    rng = np.random.default_rng(seed)
    net = ByteCnn(rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32),
                  np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS),
                  float(np.log(labels_.mean() / (1 - labels_.mean()))))
    net.tables[:, PAD] = 0
    params = [net.tables, net.bias, net.weights, np.array([net.offset])]
    moments = [(np.zeros(p.shape), np.zeros(p.shape)) for p in params]
    raw = [(t or "").encode() for t in texts]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        for at in range(0, len(raw), batch):
            rows = order[at:at + batch]
            data = np.frombuffer(b"".join(raw[r] for r in rows), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(raw[r]) for r in rows])])
            net.offset = float(params[3][0])
            grads = _gradients(net, data, offsets, labels_[rows])
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    net.offset = float(params[3][0])
    return net


def _gradients(net: ByteCnn, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray):
    response, first, padded = net.responses(data, offsets)
    n_blocks, docs = len(response), len(labels)
    where = response.argmax(axis=1)  # the winning position of each block and filter
    block_max = np.take_along_axis(response, where[:, None], 1)[:, 0]
    top, mean = net.pool(block_max, first)
    features = np.concatenate([top, mean], axis=1).astype(np.float64)
    z = np.clip(features @ net.weights + net.offset, -40, 40)
    wrong = (1 / (1 + np.exp(-z)) - labels) / docs
    d_weights = features.T @ wrong + 1e-4 * net.weights
    d_features = wrong[:, None] * net.weights
    # Back to the blocks: a chunk's maximum came from its own block or from the next one.
    relu = np.maximum(block_max, 0)
    doc_of = np.repeat(np.arange(docs), np.diff(first))
    right = relu.copy()
    right[:-1] = relu[1:]
    right[first[1:] - 1] = -1
    chunk = np.maximum(relu, right)
    source = np.arange(n_blocks)[:, None] + (right > relu)
    d_chunk = (d_features[:, FILTERS:] / np.diff(first)[:, None])[doc_of]
    winner = chunk >= top[doc_of]
    share = np.add.reduceat(winner, first[:-1])[doc_of]
    d_chunk += winner * (d_features[:, :FILTERS][doc_of] / share)
    d_block = np.zeros((n_blocks, FILTERS))
    columns = np.broadcast_to(np.arange(FILTERS), source.shape)
    np.add.at(d_block, (source, columns), d_chunk)
    d_block *= block_max > 0
    d_tables = np.zeros(net.tables.shape)
    start = (np.arange(n_blocks)[:, None] * BLOCK + where) * STRIDE
    for j in range(WIDTH):
        np.add.at(d_tables[j], (padded[start + j], columns), d_block)
    d_tables[:, PAD] = 0
    return [d_tables, d_block.sum(axis=0), d_weights, np.array([wrong.sum()])]


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
          max_rows: int = 4000, max_bytes: int = 1 << 24) -> ByteCnn:
    """Fit on labelled rows outside the held-out fold.

    The sample is the ``max_rows`` rows of the smallest hash of doc_id, cut after
    the text that reaches ``max_bytes``; both bound what the driver gets.
    """
    picked = (labels.select("doc_id", "quality")
              .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
              .where(training_fold("doc_id", folds) != held_out)
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
            .limit(max_rows).toLocalIterator())
    texts, marks, size = [], [], 0
    for r in rows:
        texts.append(r["text"])
        marks.append(r["quality"])
        size += len(r["text"] or "")
        if size >= max_bytes:
            break
    return fit(texts, marks)


def score_column(net: ByteCnn, text: Column) -> Column:
    """Probability of label 1 for each whole text."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(net.score(*text_bytes(texts)), pa.float64())

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
                  folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    net = train(docs, labels, folds, held_out)
    scored = docs.select("doc_id", (training_fold("doc_id", folds) == held_out).alias("held_out"),
                         score_column(net, F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose predicted label is 1."""
    net = train(docs, labels)
    return docs.where(score_column(net, F.col("text")) >= threshold)
