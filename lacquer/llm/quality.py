"""Quality scores by naive Bayes support vectors over hashed n-gram indicators.

Indicators of byte n-grams and words are scaled by the log ratio of their counts
in the two classes; a linear model of hinge loss is fitted to the scaled and
normalised rows by dual coordinate descent; a sigmoid on cross-fitted margins
makes the margin a probability. Fitting uses a bounded sample of labelled rows,
scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, blocks, ship, utf8, word_hashes, words

BITS = 18
GRAMS = (1, 2, 3)


def indicators(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct hashed feature of each row, sorted; at most 4,096 rows at a time."""
    data, at = utf8(text)
    n = len(at) - 1
    row = np.repeat(np.arange(n, dtype=np.uint32), np.diff(at)) << np.uint32(BITS)
    shift, keys = np.uint32(32 - BITS), []
    gram = np.zeros(len(data), np.uint32)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    for k in range(max(GRAMS)):
        gram = gram[: len(data) - k] if k else gram
        gram = (gram << np.uint32(8)) | data[k:]
        if k + 1 in GRAMS:
            inside = left[: len(gram)] > k
            keys.append((row[: len(gram)] | (((gram + np.uint32(k)) * np.uint32(0x9E3779B1)) >> shift))[inside])
        if len(gram) <= 1:
            break
    starts, ends, word_at = words(data, at, BLANKS)
    owner = np.repeat(np.arange(n, dtype=np.uint32), np.diff(word_at)) << np.uint32(BITS)
    hashes = word_hashes(data, starts, ends)
    keys.append(owner | (hashes >> np.uint64(64 - BITS)).astype(np.uint32))
    # a word that follows itself is a bigram of one class, seen once, twice, four times and so on
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])) if len(hashes) else np.zeros(0, np.int64)
    nth = np.arange(len(same)) - np.searchsorted(owner[same], owner[same]) + 1
    mark = (nth & (nth - 1)) == 0
    keys.append(owner[same[mark]] | ((nth[mark].astype(np.uint32) * np.uint32(0x85EBCA6B)) >> shift))
    every = np.sort(np.concatenate(keys))
    if len(every):
        every = every[np.r_[True, every[1:] != every[:-1]]]
    return every >> np.uint32(BITS), every & np.uint32((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """score = sigmoid(slope * (weight . x / |x| + bias) + shift) with x the class ratios of the row's buckets."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[bucket]
        norm = np.sqrt(np.bincount(row, r * r, n))
        dot = np.bincount(row, r * self.weight[bucket], n)
        return np.where(norm > 0, dot / np.maximum(norm, 1e-12), 0) + self.bias

    def scores(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(row, bucket, n) + self.shift, -30, 30)))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log of the share of each bucket in the documents of label 1 over that in those of label 0."""
    counts = [np.full(1 << BITS, smoothing) for _ in range(2)]
    for bucket, y in zip(rows, labels, strict=True):
        counts[y][bucket] += 1
    return np.log(counts[1] / (labels.sum() + 2 * smoothing)) - np.log(counts[0] / ((1 - labels).sum() + 2 * smoothing))


def descend(rows: list[np.ndarray], labels: np.ndarray, cost: float, epochs: int, mixing: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratios, weights and bias: hinge loss by dual coordinate descent, classes weighted evenly; weights are mixed with their mean size."""
    ratio = log_ratios(rows, labels)
    w, bias = np.zeros(1 << BITS), 0.0
    values = [ratio[b] / max(1e-12, float(np.linalg.norm(ratio[b]))) for b in rows]
    most = cost * len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            b, x, y = rows[i], values[i], 2 * labels[i] - 1
            new = min(max(alpha[i] - (y * (float(w[b] @ x) + bias) - 1) / 2, 0.0), most[labels[i]])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[b] += step * x
                bias += step
                alpha[i] = new
    used = w != 0
    w[used] = mixing * w[used] + (1 - mixing) * np.abs(w[used]).mean() * np.sign(w[used]) if used.any() else w[used]
    return ratio, w, bias


def sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least loss, with smoothed targets, by Newton's method."""
    pos, neg = int(labels.sum()), int((1 - labels).sum())
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margins * margins).sum() + 1e-6, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 8, mixing: float = 0.75, folds: int = 3, seed: int = 7) -> Model:
    """A model of rows of distinct buckets; with one class only, or no rows, it scores the smoothed share of label 1."""
    labels = labels.astype(np.int64)
    if not 0 < labels.sum() < len(labels):
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    fold = np.random.default_rng(seed).permutation(len(rows)) % folds
    margins = np.zeros(len(rows))
    for f in range(folds):
        mine = [i for i in range(len(rows)) if fold[i] != f]
        if 0 < labels[mine].sum() < len(mine):
            part = Model(*descend([rows[i] for i in mine], labels[mine], cost, epochs, mixing, seed), 1.0, 0.0)
            for i in np.flatnonzero(fold == f):
                margins[i] = part.margins(np.zeros(len(rows[i]), np.int64), rows[i], 1)[0]
    slope, shift = sigmoid(margins, labels)
    ratio, w, bias = descend(rows, labels, cost, epochs, mixing, seed)
    return Model(ratio.astype(np.float32), w.astype(np.float32), bias, slope, shift)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, most: int = 8000) -> Model:
    """Fit to the labelled documents outside the held-out fifth; of more than `most`, those whose id hashes lowest.

    The sample's ids, at most `most`, go to the documents, and the sample's
    buckets come to the driver. Labels other than 0 and 1 are ignored; of
    differing labels of one document the larger counts, and of rows that repeat
    its id one is taken. Null texts are empty ones.
    """
    ship(documents.sparkSession)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # an id that many rows repeat is one row of the sample: the one whose text hashes lowest
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            row, bucket = indicators(part.column(1))
            at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32)))], ["y", "buckets"])

    got = texts.mapInArrow(run, "y int, buckets array<int>").toArrow()
    rows = [np.asarray(x.values) for x in got.column("buckets").combine_chunks()] if got.num_rows else []
    # the order that tasks end in must not change the fit
    ys = got.column("y").to_numpy().astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    by = sorted(range(len(rows)), key=lambda i: (ys[i], rows[i].tobytes()))
    return fit_rows([rows[i] for i in by], ys[by])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document, a null text as an empty one; repeated rows are scored alike."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(*indicators(part.column(1)), part.num_rows))], ["doc_id", "score"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, score double")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks(batches, "text", 2_000_000):
        for lo in range(0, part.num_rows, 4096):
            yield part.slice(lo, 4096)


def keep(documents: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """All columns of the rows that score `least` or more, each by its own text (null: empty), whatever its doc_id."""
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            text = part.column(part.schema.get_field_index("text"))
            yield part.filter(pa.array(shared.value.scores(*indicators(text), part.num_rows) >= least))

    return documents.mapInArrow(run, documents.schema)


def report(documents: DataFrame, labels: DataFrame, least: float = 0.3, most: int = 8000) -> DataFrame:
    scored = score(documents, fit(documents, labels, most))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
