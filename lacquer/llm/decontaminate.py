"""Benchmark decontamination by suffix arrays over shards of the training text.

Each task turns its documents, some megabytes at a time, into a suffix array
over words and binary-searches every suffix of the benchmark in it. A match of
`window` words, or of a whole shorter item, makes the document contaminated.
Documents never move: the benchmark goes to them, in blocks of proven size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import ALNUM, LOWER, blocks, ship, stored, utf8, word_hashes, words
from .suffixes import find, suffix_array

FOUND = "id long, n_words long, starts array<int>, ends array<int>, items array<string>, longest array<int>"


def test_suffixes(items: list[tuple[str, str | None]], window: int) -> dict:
    """The items' words as hashes, once; where each distinct window begins and its length; and all its occurrences.

    An item of fewer words is one window. The arrays have some 40 bytes a word.
    """
    data, at = utf8(pa.array([t or "" for _, t in items], pa.string()))
    data = LOWER[data]
    starts, ends, word_at = words(data, at, ALNUM)
    symbols = word_hashes(data, starts, ends)
    n = np.diff(word_at)
    count = np.where(n > 0, np.maximum(1, n - window + 1), 0)
    item = np.repeat(np.arange(len(n)), count)
    begin = word_at[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    stops = np.repeat(word_at[1:], n)
    _, rank = suffix_array(symbols, stops, window)
    # windows of one rank are equal; sorted by it, the first stands for all
    by = np.argsort(rank[begin], kind="stable") if len(begin) else np.zeros(0, np.int64)
    begin, item = begin[by], item[by]
    head = np.flatnonzero(np.r_[True, rank[begin][1:] != rank[begin][:-1]]) if len(begin) else np.zeros(0, np.int64)
    return {
        "symbols": symbols, "stops": stops, "at": begin[head], "lengths": np.minimum(stops[begin[head]] - begin[head], window),
        "occurs": begin, "item": item.astype(np.int32), "edges": np.append(head, len(begin)), "names": [i for i, _ in items],
    }


def longest_matches(symbols: np.ndarray, stops: np.ndarray, where: np.ndarray, which: np.ndarray, tests: dict, chunk: int = 1 << 20) -> np.ndarray:
    """Of each hit (position, window) the longest run of words that it has in common with any item from the window's start on."""
    most = tests["lengths"][which].copy()
    edges = tests["edges"]
    upto = np.cumsum(edges[which + 1] - edges[which])
    lo = 0
    while lo < len(where):  # some hits with all occurrences of their windows
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + chunk, "right")))
        n = edges[which[lo:hi] + 1] - edges[which[lo:hi]]
        for first in range(0, int(n.max()), chunk):  # a window may have more occurrences than that itself
            part = np.clip(n - first, 0, chunk)
            hit = np.repeat(np.arange(lo, hi), part)
            occurrence = tests["occurs"][np.repeat(edges[which[lo:hi]] + first, part) + np.arange(len(hit)) - np.repeat(np.cumsum(part) - part, part)]
            reach = tests["lengths"][which[hit]].astype(np.int64)
            room = np.minimum(stops[where[hit]] - where[hit], tests["stops"][occurrence] - occurrence)
            alive = np.flatnonzero(reach < room)
            while len(alive):
                alive = alive[tests["symbols"][occurrence[alive] + reach[alive]] == symbols[where[hit[alive]] + reach[alive]]]
                reach[alive] += 1
                alive = alive[reach[alive] < room[alive]]
            np.maximum.at(most, hit, reach)
        lo = hi
    return most


def search(batch: pa.RecordBatch, tests: dict, window: int, longest: bool = True) -> pa.RecordBatch:
    """One shard: suffix array, binary search, and the located matches of its documents; the first column stays."""
    data, at = utf8(batch.column(1))
    data = LOWER[data]
    starts, ends, word_at = words(data, at, ALNUM)
    symbols = word_hashes(data, starts, ends)
    n = batch.num_rows
    found_starts: list[list[int]] = [[] for _ in range(n)]
    found_ends: list[list[int]] = [[] for _ in range(n)]
    found_items: list[list[str]] = [[] for _ in range(n)]
    most: list[list[int]] = [[] for _ in range(n)]
    if len(symbols) and len(tests["at"]):
        stops = np.repeat(word_at[1:], np.diff(word_at))
        order, _ = suffix_array(symbols, stops, int(tests["lengths"].max()))
        lo, hi = find(symbols, stops, order, tests["symbols"], tests["at"], tests["lengths"])
        n_hits = hi - lo
        which = np.repeat(np.arange(len(lo)), n_hits)
        where = order[np.repeat(lo, n_hits) + np.arange(len(which)) - np.repeat(np.cumsum(n_hits) - n_hits, n_hits)]
        by = np.lexsort((which, where))
        where, which = where[by], which[by]
        reach = longest_matches(symbols, stops, where, which, tests) if longest else tests["lengths"][which]
        doc = np.searchsorted(word_at, where, "right") - 1
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)]).tolist()
        for a, b in zip(edge, [*edge[1:], len(doc)], strict=False):
            d = int(doc[a])
            s = where[a:b] - word_at[d]
            e = s + tests["lengths"][which[a:b]]
            cover = np.maximum.accumulate(e)
            cut = np.flatnonzero(np.r_[True, s[1:] > cover[:-1]])
            found_starts[d] = s[cut].tolist()
            found_ends[d] = cover[np.r_[cut[1:], len(s)] - 1].tolist()
            most[d] = [int(np.max(reach[a:b]))]
            own = np.unique(np.concatenate([tests["item"][tests["edges"][k] : tests["edges"][k + 1]] for k in np.unique(which[a:b])]))
            found_items[d] = sorted({tests["names"][i] for i in own.tolist()} - {None})
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(np.diff(word_at), pa.int64()), pa.array(found_starts, pa.list_(pa.int32())), pa.array(found_ends, pa.list_(pa.int32())), pa.array(found_items, pa.list_(pa.string())), pa.array(most, pa.list_(pa.int32()))],
        ["id", "n_words", "starts", "ends", "items", "longest"],
    )


def benchmark_blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The distinct items in blocks of about most_bytes, each fetched by itself; one item longer than that is a block."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = own.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("item_id"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-2 * total // most_bytes)) if total > most_bytes else 1
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def matches(documents: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 4_000_000, block_bytes: int = 8_000_000) -> DataFrame:
    """Per row: doc_id, n_words, covered word ranges (starts, ends), ids of the items found, longest match in words.

    Null and empty texts have no words. An item without words is never found,
    one without an id contaminates but is not named.
    Every row is reported by its own text, whatever its doc_id, and alike for any
    number of blocks: where the benchmark has more than one (of block_bytes),
    rows get a number of their own in a written table, and their matches in all
    blocks are joined by it. Other columns of either table are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    own = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def one(rows: DataFrame, items: list[tuple[str, str | None]]) -> DataFrame:
        tests = spark.sparkContext.broadcast(test_suffixes(items, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in blocks(batches, "text", shard_bytes):
                yield search(part, tests.value, window)

        return rows.mapInArrow(run, FOUND)

    first_two = list(islice(benchmark_blocks(benchmark, block_bytes), 2))
    if len(first_two) == 1:
        return one(own, first_two[0]).withColumnRenamed("id", "doc_id")
    numbered = stored(own.withColumnRenamed("id", "doc_id").withColumn("id", F.monotonically_increasing_id()), "numbered")
    texts, parts = numbered.select("id", "text"), None
    for items in benchmark_blocks(benchmark, block_bytes):
        part = one(texts, items)
        # rows without a match are needed once; each block's matches are written before the next block is sent
        part = stored(part if parts is None else part.where(F.size("starts") > 0), "matches")
        parts = part if parts is None else parts.unionByName(part)
    found = parts.groupBy("id").agg(F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items", "longest")))
    return numbered.select("id", "doc_id").join(found, "id").drop("id")


def report(documents: DataFrame, benchmark: DataFrame, window: int = 10, **sizes: int) -> DataFrame:
    """matches() as counts: n_hit words covered, n_items, the items' digest, the longest match and the verdict."""
    found = matches(documents, benchmark, window, **sizes)
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("upto")),
        lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0), s.ends - F.greatest(s.starts, acc.upto))).cast("long").alias("n"), F.greatest(acc.upto, s.ends).alias("upto")),
        lambda acc: acc.n,
    )
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
        F.coalesce(F.array_max("longest"), F.lit(0)).cast("long").alias("longest_match"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 4_000_000, block_bytes: int = 8_000_000) -> DataFrame:
    """The documents, all columns, without those that hold a window of any item.

    Rows are judged by their own text: null and repeated doc_ids are like others,
    and a text without words stays. With one block of items rows stay in their
    tasks; with more, what is left after a block is written before the next is
    sent, and a row's own columns are not looked at.
    """
    spark = documents.sparkSession
    ship(spark)

    def left(rows: DataFrame, items: list[tuple[str, str | None]]) -> DataFrame:
        tests = spark.sparkContext.broadcast(test_suffixes(items, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in blocks(batches, "text", shard_bytes):
                own = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column(part.schema.get_field_index("text"))], ["id", "text"])
                yield part.filter(pc.equal(pc.list_value_length(search(own, tests.value, window, longest=False).column(2)), 0))

        return rows.mapInArrow(run, rows.schema)

    first_two = list(islice(benchmark_blocks(benchmark, block_bytes), 2))
    if len(first_two) == 1:
        return left(documents, first_two[0])
    numbered = stored(documents.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("id")), "numbered")
    clean = numbered.select("id", "text")
    for items in benchmark_blocks(benchmark, block_bytes):
        clean = stored(left(clean, items), "clean")
    return numbered.select("row", "id").join(clean.select("id"), "id", "left_semi").select("row.*")
