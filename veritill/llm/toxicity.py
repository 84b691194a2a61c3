"""Operator 9: toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (3 to 5 bytes, with its borders) and of the whole
word, all hashed into one table, so a misspelling that was never seen shares most of its vectors with the
words it comes from. A window of 3 words is the mean of its words, and a linear softmax reads it; a text is
as toxic as its most toxic window. Table and softmax are fitted together by gradient descent with momentum on a bounded sample of
labelled documents (SAMPLE_ROWS of each label, first by a hash of their ids, outside the held-out fold), each
read whole. Labels are noisy: each half of the sample is first scored by a model of the other half, and
documents marked toxic that score like clean ones don't train the final model. The share of those that stay
sets the bias. As the softmax is linear, every distinct word is projected to one number before the windows.

Edge cases: a null or empty text has the score of no evidence; a text of any length is scored whole, in
linear time; without labels every score is 0; windows that tie for the strongest share its gradient; repeated
rows give equal rows, and several texts under one id are scored apart (for training, the least of them);
an empty table gives an empty result; columns other than doc_id and text of documents and doc_id and toxic
of labels are ignored. Labels, language, source and id never enter a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textops import Words, buffers, crc_mod, documents, in_arrow, slices, span_hashes

SAMPLE_ROWS = 900
BUCKET_BITS = 17
DIMENSION = 8
WINDOW = 3
FOLDS = 5
ROUNDS = 40
#: A toxic label isn't believed if the document scores below this quantile of clean ones.
CLEAN_QUANTILE = 0.97
RATE = 0.4
#: Documents that halve the log odds an n-gram starts from.
SHRINK = 12.0
#: Weight of the pull of the calibrated slope towards 1.
PULL = 2e-4


@dataclass
class Model:
    table: np.ndarray  # (2**BUCKET_BITS,): each bucket's vector times the difference of the softmax's two rows
    bias: float


def _strip(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words without punctuation on either side; a word of punctuation alone stays whole."""
    letter = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90))
    ahead = np.append(np.flatnonzero(letter), len(data))
    first = ahead[np.searchsorted(ahead, starts)]
    last = np.concatenate([[-1], np.flatnonzero(letter)])
    final = last[np.searchsorted(last, ends) - 1] + 1
    bare = first >= ends
    return np.where(bare, starts, first), np.where(bare, ends, final)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and where each word's begin."""
    n = ends - starts
    size = n + 2
    at = np.concatenate([[0], np.cumsum(size)])
    framed = np.full(int(at[-1]), 1, np.uint8)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    framed[np.repeat(at[:-1] + 1, n) + place] = data[np.repeat(starts, n) + place]
    counts = [np.maximum(size - k + 1, 0) for k in (3, 4, 5)]
    first = np.concatenate([[0], np.cumsum(1 + sum(counts))])
    out = np.empty(int(first[-1]), np.uint64)
    out[first[:-1]] = span_hashes(framed, at[:-1], at[1:])
    done = first[:-1] + 1
    for k, c in zip((3, 4, 5), counts, strict=True):
        place = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        begin = np.repeat(at[:-1], c) + place
        out[np.repeat(done, c) + place] = span_hashes(framed, begin, begin + k)
        done = done + c
    return (out >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), first


class Bags:
    """The distinct words of some texts, with the words of each text by number."""

    def __init__(self, w: Words):
        starts, ends = _strip(w.data, w.starts, w.ends)
        _, first, word = np.unique(span_hashes(w.data, starts, ends), return_index=True, return_inverse=True)
        self.word = word.astype(np.int32)
        self.buckets, self.at = subwords(w.data, starts[first], ends[first])
        self.sizes = np.diff(self.at)
        # a window begins at every word, but for the last ones of a text, which are inside the one before
        each = np.where(w.counts > 0, np.maximum(0, w.counts - WINDOW) + 1, 0)
        self.window_first = np.concatenate([[0], np.cumsum(each)])
        place = np.arange(int(each.sum())) - np.repeat(self.window_first[:-1], each)
        self.begin = (np.repeat(w.first[:-1], each) + place).astype(np.int32)
        self.end = np.minimum(self.begin + WINDOW, np.repeat(w.first[1:], each)).astype(np.int32)

    def window_means(self, values: np.ndarray) -> np.ndarray:
        """values: one number per distinct word."""
        sums = np.zeros(len(self.word) + 1)
        np.cumsum(values[self.word], out=sums[1:])
        return (sums[self.end] - sums[self.begin]) / (self.end - self.begin)


def logits(model: Model, w: Words) -> np.ndarray:
    """The log odds of each text."""
    out = np.full(len(w.counts), model.bias)
    bags = Bags(w)
    if len(bags.word):
        scores = np.add.reduceat(model.table[bags.buckets], bags.at[:-1]) / bags.sizes
        means = bags.window_means(scores)
        full = np.flatnonzero(w.counts)
        out[full] += np.maximum.reduceat(means, bags.window_first[:-1][full])
    return out


def _log_odds(bags: Bags, bucket: np.ndarray, w: Words, toxic: np.ndarray, buckets: int) -> np.ndarray:
    """For each bucket the log odds of a toxic document to have it, times n / (n + SHRINK) for its n documents."""
    held = np.zeros((2, buckets))
    for row, label in enumerate(toxic):
        word = np.unique(bags.word[w.first[row] : w.first[row + 1]])
        many = bags.sizes[word]
        at = np.repeat(bags.at[word] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        held[int(label), np.unique(bucket[at])] += 1
    good, bad = held
    odds = np.log((bad + 1) / (toxic.sum() + 2)) - np.log((good + 1) / (len(toxic) - toxic.sum() + 2))
    return odds * (good + bad) / (good + bad + SHRINK)


def train(texts: list[bytes], toxic: np.ndarray, prior: float, rounds: int = ROUNDS, seed: int = 3) -> Model:
    """Fits vectors and softmax together; the gradient of a text goes to its strongest window.

    A text's log odds are linear in the vectors of its strongest window, so both gradients come from one weight
    per n-gram, and nothing is held per window but numbers.
    """
    rng = np.random.default_rng(seed)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    w = Words(np.frombuffer(b"".join(texts), np.uint8), offsets, lower=True)
    bags = Bags(w)
    full = np.flatnonzero(w.counts)
    y = toxic[full].astype(float)
    vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSION)).astype(np.float32)
    softmax = rng.normal(0, 0.3, DIMENSION)
    bias = 0.0
    ids, inverse = np.unique(bags.buckets, return_inverse=True)
    inverse = inverse.astype(np.int32)
    vectors = vectors[ids]
    owner = np.repeat(np.arange(len(bags.sizes), dtype=np.int32), bags.sizes)
    # one direction starts from each n-gram's log odds over documents, shrunk where few documents have it
    vectors[:, 0] = _log_odds(bags, inverse, w, toxic, len(ids))
    softmax[0] = 1.0
    state: list = [np.zeros_like(vectors), 0.0, np.zeros(DIMENSION), 0.0]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    spans = bags.window_first[full]
    count = np.diff(bags.window_first)[full]
    for step in range(1, rounds + 1):
        z = bags.window_means(np.add.reduceat((vectors @ softmax)[inverse], bags.at[:-1]) / bags.sizes)
        top = np.maximum.reduceat(z, spans)
        chosen = np.flatnonzero(z == np.repeat(top, count))
        text = np.searchsorted(spans, chosen, "right") - 1
        slope = weight * (1 / (1 + np.exp(-np.clip(top + bias, -30, 30))) - y)
        pull = (slope / np.bincount(text, minlength=len(full)))[text]
        # back from windows to words and n-grams
        length = bags.end[chosen] - bags.begin[chosen]
        at = np.repeat(bags.begin[chosen] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        by_word = np.bincount(bags.word[at], np.repeat(pull / length, length), len(bags.sizes)) / bags.sizes
        by_bucket = np.bincount(inverse, by_word[owner], len(ids))
        g_softmax = by_bucket @ vectors + 1e-4 * softmax
        g_vectors = by_bucket[:, None].astype(np.float32) * softmax.astype(np.float32) + 2e-6 * vectors
        # momentum with one step size for all: a rare n-gram moves as little as its gradient says, unlike under Adam
        for k, (value, g, rate) in enumerate(((vectors, g_vectors, RATE), (softmax, g_softmax, 0.05))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = max(0.99 * state[2 * k + 1], float(np.abs(g).max()))
            value -= rate * (state[2 * k] / (1 - 0.9**step)) / (state[2 * k + 1] + 1e-9)
        bias -= 0.5 * slope.sum()
    table = np.zeros(1 << BUCKET_BITS)
    table[ids] = vectors @ softmax
    own = logits(Model(table, 0.0), w)[full]
    a, b = _calibrate(own, y, weight)
    return Model(table * a, b + float(np.log(prior / (1 - prior))))


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, by Newton steps, with a little pull towards a slope of 1."""
    a, b = 1.0, -float(np.median(z))
    for _ in range(120):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        e, s = weight * (p - y), weight * p * (1 - p)
        g = np.array([(e * z).sum() + PULL * (a - 1), e.sum()])
        h = np.array([[(s * z * z).sum() + PULL, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - float(np.clip(move[0], -0.5, 0.5)), b - float(np.clip(move[1], -2, 2))
    return max(a, 0.01), b


def credible(texts: list[bytes], toxic: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Which documents train the final model: clean ones, and toxic ones that a model of the other half tells from clean ones."""
    keep = np.ones(len(texts), bool)
    half = np.arange(len(texts)) % 2
    for k in (0, 1):
        own, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        if len(set(toxic[other])) < 2 or len(set(toxic[own])) < 2:
            continue
        model = train([texts[i] for i in other], toxic[other], 0.5, rounds)
        offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
        z = logits(model, Words(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), offsets, lower=True))
        limit = np.quantile(z[toxic[own] == 0], CLEAN_QUANTILE)
        keep[own[(toxic[own] == 1) & (z <= limit)]] = False
    return keep if toxic[keep].any() else np.ones(len(texts), bool)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on at most sample_rows whole documents of each label, outside the held-out fold."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(crc_mod(F.col("doc_id"), FOLDS) != 0)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if not share.get(0) or not share.get(1):
        return Model(np.zeros(1 << BUCKET_BITS), -1e9)
    chosen = [labels.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for t in (0, 1)]
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.col("text").cast("binary")).alias("text"))
    found = sorted((r["doc_id"], bytes(r["text"]), r["toxic"]) for r in rows.collect())
    if len({t for _, _, t in found}) < 2:
        return Model(np.zeros(1 << BUCKET_BITS), -1e9)
    texts, toxic = [t for _, t, _ in found], np.array([t for _, _, t in found])
    keep = credible(texts, toxic)
    believed = share[1] * toxic[keep].sum() / toxic.sum()
    return train([t for t, k in zip(texts, keep, strict=True) if k], toxic[keep], believed / (share[0] + share[1]))


RESULT = "doc_id bigint, held_out boolean, score double, predicted int"


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            data, offsets = buffers(batch["text"])
            for i, j in slices(offsets):
                z = logits(model, Words(data, offsets[i : j + 1], lower=True))
                p = np.where(z < -1e8, 0.0, 1 / (1 + np.exp(-np.clip(z, -40, 40))))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def detect(docs: DataFrame, labels: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(rows, labels))
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out")
    return in_arrow(rows.select("doc_id", held, "text"), _score(shared), RESULT)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
