"""A quality classifier on hashed word and character n-gram vectors.

A document's vector is the sum of three means of learned vectors: those of its
byte 2- to 4-grams, of its words and word pairs, and of a pattern that says
whether a word repeats one of the two before it; a softmax layer follows.  It
is trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows, in one task.  To score, the output layer is folded into the
vectors once, which leaves one number for each bucket.

Edge cases: null and empty texts have no n-grams and get the score of the bias
alone; without usable labels every score is 0.5; labels that a doc_id has
twice count by their least, and of its texts the least is learned from; every
row is scored by its own text, repeated ones and those without a doc_id too;
a text longer than a slice is scored by stretches, with the same result; extra
columns are ignored, or kept by drop_low_quality, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import NOT_SPACE, SLICE_BYTES, mix64, shingles, slices, words_of
from ._spark import bounded_batches, give_back, map_batches

BITS, DIM, GROUPS = 16, 8, 3


@dataclass(frozen=True)
class Training:
    """sample bounds the labelled rows that the model is fitted on."""

    sample: int = 2000
    epochs: int = 6
    rate: float = 0.5
    seed: int = 5


def char_grams(text: bytes, starts: int) -> Iterator[np.ndarray]:
    """Buckets of the byte 2- to 4-grams that begin at the first `starts` places of a text."""
    h = raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    h = h * np.uint32(0x9E3779B1)
    for n in (2, 3, 4):
        h = h[:-1] * np.uint32(0x01000193) + raw[n - 1 :] if len(h) > 1 else h[:0]
        yield (h[:starts] * np.uint32(0x85EBCA6B) ^ np.uint32(n * 0x28E31DA4)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group the buckets of all texts' features, and which text each is of."""
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.cumsum(sizes)[owner] - 1 - np.arange(len(owner))
    grams, owners = [], []
    for n, buckets in enumerate(char_grams(b"\n".join([*texts, b""]), len(owner)), 2):
        inside = left[: len(buckets)] >= n
        grams.append(buckets[inside])
        owners.append(owner[: len(buckets)][inside])
    return [(np.concatenate(grams), np.concatenate(owners)), *word_features(texts)]


def word_features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The groups of words and word pairs, and of repeats."""
    w = words_of(texts, NOT_SPACE, fold=False)
    text_of = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    pairs = shingles(w.hashes, 2)
    same = text_of[1:] == text_of[:-1]
    top = np.uint64(64 - BITS)
    words = np.concatenate([mix64(w.hashes) >> top, pairs[same] >> top]).astype(np.uint32)
    again = np.zeros(len(w.hashes), np.uint32)
    for lag in (1, 2):
        if len(again) > lag:
            again[lag:] |= (w.hashes[lag:] == w.hashes[:-lag]) & (text_of[lag:] == text_of[:-lag])
    return [(words, np.concatenate([text_of, text_of[1:][same]])), (again, text_of)]


def fit(texts: list[bytes], labels: list[int], t: Training) -> tuple[np.ndarray, float]:
    """Numbers by group and bucket, and the bias: their means and it add up to the log odds of label 1."""
    rng = np.random.Generator(np.random.PCG64(t.seed))
    vectors = rng.normal(0, 1 / DIM, (GROUPS, 2**BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    # Buckets in 16 bits and shares in 32: the sample's features are held while it is gone over.
    rows = [[(u.astype(np.uint16), (c / c.sum()).astype(np.float32)) for u, c in (np.unique(b, return_counts=True) for b, _ in features([text]))] for text in texts]
    steps, done = t.epochs * len(rows), 0
    for _ in range(t.epochs):
        for i in rng.permutation(len(rows)):
            row = [(u.astype(np.intp), w) for u, w in rows[i]]
            rate = t.rate * (1 - done / steps)
            done += 1
            v = sum(w @ vectors[g, u] for g, (u, w) in enumerate(row) if len(u))
            if np.isscalar(v):
                v = np.zeros(DIM, np.float32)
            z = v @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(v, p)
            bias -= rate * p
            for g, (u, w) in enumerate(row):
                vectors[g, u] -= (rate * len(u) ** 0.5) * w[:, None] * back
    side = out[:, 1] - out[:, 0]
    return (vectors @ side).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> tuple[np.ndarray, float]:
    """The folded model, fitted in one task on at most t.sample rows of labels (doc_id, label), dealt by a hash of doc_id."""
    chosen = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(t.sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.filter("text <> ''").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, texts in slices(batch.column(1)):
                found += zip(ids[a:b], texts, marks[a:b])
        if found:
            found.sort()
            table, bias = fit([x[1] for x in found], [int(x[2]) for x in found], t)
            yield pa.RecordBatch.from_pydict({"table": pa.array([table.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})
        del found
        give_back()

    bounded_batches(docs.sparkSession)
    model = rows.repartition(1).mapInArrow(work, "table binary, bias double").collect()
    if not model:
        return np.zeros((GROUPS, 2**BITS), np.float32), 0.0
    return np.frombuffer(bytes(model[0]["table"]), np.float32).reshape(GROUPS, 2**BITS), model[0]["bias"]


def _means(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Of each text, the sum of its groups' means."""
    z = np.zeros(len(texts))
    for g, (buckets, owner) in enumerate(features(texts)):
        sums, counts = np.bincount(owner, table[g][buckets], len(texts)), np.bincount(owner, minlength=len(texts))
        z += sums / np.maximum(counts, 1)
    return z


def _mean_of_long(text: bytes, table: np.ndarray) -> np.ndarray:
    """_means of a single text, whose byte n-grams are taken by stretches."""
    sums, n = 0.0, 0
    for a in range(0, len(text), SLICE_BYTES):
        for buckets in char_grams(text[a : a + SLICE_BYTES + 3], SLICE_BYTES):
            sums, n = sums + table[0][buckets].sum(dtype=np.float64), n + len(buckets)
    z = sums / max(n, 1)
    for g, (buckets, _) in enumerate(word_features([text]), 1):
        z += table[g][buckets].sum(dtype=np.float64) / max(len(buckets), 1)
    return np.array([z])


def scores(column: pa.Array, model: tuple[np.ndarray, float]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of rows of a column of texts and their scores."""
    table, bias = model
    for a, b, texts in slices(column):
        z = bias + (_mean_of_long(texts[0], table) if len(texts[0]) > SLICE_BYTES else _means(texts, table))
        yield a, b, 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs; the model has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        for a, b, found in scores(batch.column(1), shared.value):
            yield {"doc_id": batch.column(0).slice(a, b - a), "score": found}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), work, "doc_id long, score double")


def held_out() -> Column:
    """Rows that no model learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows of labels that models may learn from."""
    return labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> DataFrame:
    """docs without the rows whose own text scores under 0.5; all columns are kept, and no row is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, learnable(labels), t))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool), *(found >= 0.5 for _, _, found in scores(batch.column(at), shared.value))]
            yield batch.filter(pa.array(np.concatenate(keep)))
        give_back()

    bounded_batches(docs.sparkSession)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # any name may be among them
    return plain.mapInArrow(work, plain.schema).toDF(*docs.columns)
