"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio between trusted documents and the raw corpus.

Words and pairs of words are hashed to buckets. Two multinomials over the
buckets, one of the trusted documents and one of all documents, give each bucket
the logarithm of their ratio, as an integer. A text's score is the sum over its
n-grams by their number; it is held against a fixed threshold, document by
document, without drawing. All of it after the two tables of counts is integer
arithmetic, so that a result doesn't depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BLANKS, bit_filter, blocks, flagged, rolling, ship, utf8, word_hashes, words

BUCKETS = 1 << 16
#: Log ratios are counted in steps of this part of one.
STEP = 1 << 16
#: What each bucket has in the target besides its count.
PRIOR = 8.0
#: A text is kept from this mean log ratio on. Trusted texts lie around 0.03, texts of repeated phrases or junk below -0.2.
THRESHOLD = -0.12
PRIME = (1 << 31) - 1
#: Multipliers of a word alone, and of the first and second word of a pair.
ALONE, FIRST, SECOND = 40692, 69621, 48271
#: What a character counts in its word, by its place modulo 64: powers of a primitive root.
PLACES = [pow(16807, i + 1, PRIME) for i in range(64)]
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


class Texts:
    """The words of a column of texts, by code points. Nulls are empty."""

    def __init__(self, column: pa.Array) -> None:
        self.bytes, self.byte_at = utf8(column)
        self.chars = np.frombuffer(self.bytes.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        begun = np.r_[0, np.cumsum((self.bytes & 0xC0) != 0x80)]
        self.at = begun[self.byte_at]
        self.starts, self.ends, self.word_at = words(np.minimum(self.chars, 255).astype(np.uint8), self.at, BLANKS)
        self.doc = np.repeat(np.arange(len(self.at) - 1), np.diff(self.word_at))

    def buckets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bucket of every word and of every pair of neighbours, and the document of each pair."""
        own = self.chars + 32 * ((self.chars >= 65) & (self.chars <= 90))
        n = self.ends - self.starts
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        total = np.r_[0, np.cumsum(own[np.repeat(self.starts, n) + inner] * np.array(PLACES)[inner & 63] % PRIME)]
        edge = np.r_[0, np.cumsum(n)]
        word = (total[edge[1:]] - total[edge[:-1]]) % PRIME
        pair = np.flatnonzero(self.doc[1:] == self.doc[:-1]) if len(word) else np.zeros(0, np.int64)
        return word * ALONE % PRIME % BUCKETS, (word[pair] * FIRST + word[pair + 1] * SECOND) % PRIME % BUCKETS, self.doc[pair]


def _valid(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text").cast("string")).alias("text"))


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in a column of texts, over all of them; combined in the tasks, then by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in blocks(batches, "text", 4_000_000):
            alone, pairs, _ = Texts(part.column(0)).buckets()
            total += np.bincount(alone, minlength=BUCKETS) + np.bincount(pairs, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    got = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids that labels call good and never bad or toxic; a null label says nothing."""
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return own.agg(F.min("quality").alias("worst"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).where("worst = 1 and toxic = 0").select("doc_id")


def trusted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of trusted ids. Only texts that pass a bit filter of the ids travel, to a join by sorting at any size, whose hot ids Spark splits."""
    spark = documents.sparkSession
    ids = trusted_ids(labels)
    flags = spark.sparkContext.broadcast(bit_filter(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(flagged(flags.value, batch.column(0).to_numpy(zero_copy_only=False))))

    return _valid(documents.where("doc_id is not null")).mapInArrow(run, "doc_id long, text string").join(ids.hint("merge"), "doc_id", "left_semi")


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Of each bucket the logarithm of its odds in the target over those in the raw corpus, in steps.

    Each bucket has `prior` more in the target, and as many more in the raw
    corpus as make that no evidence, so that what the corpus has seldom says
    little: without, texts that no label calls trusted would lose by every n-gram
    of their own.
    """
    expected = raw * (float(target.sum()) / max(1.0, float(raw.sum())))
    return np.floor(np.log((target + prior) / (expected + prior)) * STEP + 0.5).astype(np.int64)


def fit(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratios of all buckets, from the whole texts of all documents and of all trusted ones."""
    ship(documents.sparkSession)
    return log_ratios(counts(trusted(documents, labels)), counts(_valid(documents)))


def repeats(texts: Texts, width: int = 3) -> np.ndarray:
    """Words of each text in windows of this many words that the text has twice or more."""
    n = len(texts.at) - 1
    if not len(texts.starts):
        return np.zeros(n, np.int64)
    begun = np.flatnonzero((texts.bytes & 0xC0) != 0x80)
    begun = np.r_[begun, len(texts.bytes)]
    symbols = word_hashes(texts.bytes, begun[texts.starts], begun[texts.ends])
    head = np.flatnonzero(texts.word_at[1:][texts.doc] - np.arange(len(symbols)) >= width)
    keys, doc = rolling(symbols, head, head + width), texts.doc[head]
    by = np.lexsort((keys, doc))
    same = (keys[by][1:] == keys[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    twice = np.zeros(len(by), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, head[by[twice]], 1)
    np.add.at(cover, head[by[twice]] + width, -1)
    return np.bincount(texts.doc, np.cumsum(cover)[:-1] > 0, n).astype(np.int64)


def repeated_lines(texts: Texts) -> np.ndarray:
    """Lines of each text that have a word and equal an earlier one."""
    n = len(texts.at) - 1
    cut = np.flatnonzero(texts.bytes == 10)
    lo = np.unique(np.r_[texts.byte_at[:-1], cut + 1])
    lo = lo[lo < len(texts.bytes)]
    if not len(lo):
        return np.zeros(n, np.int64)
    stop = np.unique(np.r_[texts.byte_at[1:], cut])
    hi = np.where(texts.bytes[lo] == 10, lo, stop[np.minimum(np.searchsorted(stop, lo, "right"), len(stop) - 1)])
    word = np.r_[0, np.cumsum(BLANKS[texts.bytes])]
    some = word[hi] > word[lo]
    lo, hi = lo[some], hi[some]
    doc = np.searchsorted(texts.byte_at, lo, "right") - 1
    keys = word_hashes(texts.bytes, lo, hi)
    by = np.lexsort((keys, doc))
    again = (keys[by][1:] == keys[by][:-1]) & (doc[by][1:] == doc[by][:-1])
    return np.bincount(doc[by][1:][again], minlength=n).astype(np.int64)


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_grams long, score long, kept boolean"


def judged(documents: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Of every document its counts, its number of n-grams, the sum of their log ratios in steps, and whether it is kept.

    base_failed: fewer words than least_words, or more than most_repeated
    percent of them in repeated windows of three words. A document that passes
    is kept if score >= threshold * n_grams, with the threshold rounded to a
    step. A null text is empty; repeated rows are each judged; long texts whole.
    """
    spark = documents.sparkSession
    ship(spark)
    sent, limit = spark.sparkContext.broadcast(ratios), int(np.floor(threshold * STEP + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4_000_000):
            texts = Texts(part.column(1))
            n, ends = part.num_rows, np.r_[0, np.cumsum(SYMBOLS[texts.bytes])]
            n_words = np.diff(texts.word_at)
            chars = np.bincount(texts.doc, texts.ends - texts.starts, n).astype(np.int64)
            repeated = repeats(texts)
            failed = (n_words < least_words) | (100 * repeated > most_repeated * n_words)
            alone, pairs, pair_doc = texts.buckets()
            score = np.zeros(n, np.int64)
            np.add.at(score, texts.doc, sent.value[alone])
            np.add.at(score, pair_doc, sent.value[pairs])
            grams = n_words + np.maximum(n_words - 1, 0)
            columns = [n_words, chars, np.diff(ends[texts.byte_at]), repeated_lines(texts), repeated, failed, grams, score, ~failed & (score >= limit * grams)]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], [f.split()[0] for f in FIELDS.split(", ")])

    return _valid(documents).mapInArrow(run, FIELDS)
