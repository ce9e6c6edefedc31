"""Removal of word passages that repeat across documents, by prefix-partitioned suffix trees.

The trees are sparse: of the suffixes in a window only the one that begins with
the window's lowest-hashed 8-gram (its anchor) is grouped, so that neighbouring
windows stay together and travel as one stretch of text. Suffixes are grouped by
a prefix of 8 words; where a group is larger than a task should hold, by one of
16, of 32, or by the whole window, as the counts of groups demand. Each task
builds the suffix tree of its groups' stretches as a suffix array with common
prefixes. Suffixes under one node as deep as a window have that window in
common, and all but those of the smallest document are removed; the tree's
deeper nodes that differ to the left are the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import BLANKS, bit_filter, blocks, drop, flagged, mix, rolling, ship, stored, utf8, word_hashes, words
from .suffixes import suffix_array

#: Words of the prefixes that suffixes are grouped by, shortest first; a whole window comes last.
PREFIXES = (8, 16, 32)
FRONT = "key long, doc_id long, version long, start int, n int, content binary"
NAMES = ["key", "doc_id", "version", "start", "n", "content"]
#: What tells rows apart: a doc_id and a hash of it and its text, so that texts that share a doc_id are each judged by their own words.
ROW = ["doc_id", "version"]


class Windows:
    """All windows of a batch (doc_id, text): where they begin, their documents, and the prefix of each length that groups them."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.window = window
        self.data, at = utf8(batch.column(1))
        self.starts, self.ends, self.word_at = words(self.data, at, BLANKS)
        self.symbols = word_hashes(self.data, self.starts, self.ends)
        counts = np.maximum(0, np.diff(self.word_at) - window + 1)
        self.docs = np.repeat(np.arange(len(counts)), counts)
        self.positions = np.arange(len(self.docs)) - np.repeat(np.cumsum(counts) - counts, counts) + self.word_at[:-1][self.docs]
        self.lengths = [*(p for p in PREFIXES if p < window), window]
        self.anchors = self._anchors(min(PREFIXES[0], window)) if len(self.positions) else self.positions

    def _anchors(self, gram: int) -> np.ndarray:
        """Of each window the first place of its lowest gram."""
        lo = np.arange(len(self.symbols) - gram + 1)
        low, place = rolling(self.symbols, lo, lo + gram), lo
        span, size = self.window - gram + 1, 1
        while size < span:
            step = min(size, span - size)
            first = low[:-step] <= low[step:]
            low, place = np.where(first, low[:-step], low[step:]), np.where(first, place[:-step], place[step:])
            size += step
        return place[self.positions]

    def keys(self, level: int, which: np.ndarray) -> np.ndarray:
        """Hashes of the prefixes of this level: of words from the anchor on, or so far to its left as the window needs."""
        length = self.lengths[level]
        lo = np.minimum(self.anchors[which], self.positions[which] + self.window - length)
        return mix(rolling(self.symbols, lo, lo + length) + np.uint64(level)) if len(which) else np.zeros(0, np.uint64)

    def grouped(self, split: np.ndarray, further: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The key of each window, of the shortest prefix that is not among those that are split, and its level.

        `split` has the split keys of the first level, a bit filter those of the
        longer ones. What the filter takes for split by mistake is split in every
        text, so equal windows stay together.
        """
        key, level = self.keys(0, np.arange(len(self.positions))), np.zeros(len(self.positions), np.int8)
        again = np.flatnonzero(np.isin(key, split)) if len(split) else np.zeros(0, np.int64)
        for k in range(1, len(self.lengths)):
            if not len(again):
                break
            key[again], level[again] = self.keys(k, again), k
            # a whole window is never split: its suffixes are equal
            again = again[flagged(further, key[again].view(np.int64))] if further is not None else again[:0]
        return key, level

    def runs(self, key: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First (an index into which) and number of neighbouring windows of one key."""
        p, d = self.positions[which], self.docs[which]
        new = np.ones(len(which), bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (key[1:] != key[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, len(which)))


COUNTS = "level int, key long, doc_id long, version long, n int"
TOTALS = "level int, key long, a long, b long, n long"


def _counts(level: int, key: np.ndarray, docs: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (level, key, doc_id, version, n) of runs by key and row of a batch (doc_id, text, version)."""
    by = np.lexsort((key, docs))
    key, docs = key[by], docs[by]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (docs[1:] != docs[:-1])][: len(key)])
    n = np.diff(np.append(first, len(key))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), level, np.int32)), pa.array(key[first].view(np.int64)), *(part.column(k).take(pa.array(docs[first])) for k in (0, 2)), pa.array(n)], ["level", "key", *ROW, "n"])


def _summed(tables: list[pa.Table]) -> list[pa.Table]:
    """One table (level, key, a, b, n) with a row for each key: its smallest and largest doc_id and its number of runs."""
    own = pa.concat_tables(tables).group_by(["level", "key"]).aggregate([("a", "min"), ("b", "max"), ("n", "sum")])
    return [own.select(["level", "key", "a_min", "b_max", "n_sum"]).rename_columns(["level", "key", "a", "b", "n"])]


def _totals(rows: DataFrame, most: int) -> DataFrame:
    """The prefixes in more than one document, and whether their suffixes are too many for one group, from (level, key, a, b, n)."""
    totals = rows.groupBy("level", "key").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n")).where("a < b")
    return totals.select("level", "key", (F.col("n") > most).alias("split"))


def versions(documents: DataFrame) -> DataFrame:
    """doc_id, text and version."""
    return documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("version"))


def partitions(documents: DataFrame, window: int, most: int, summed: int = 500_000) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (doc_id, version) with the shortest prefixes that group their suffixes with those of other documents (`keys`) and that are split (`split`); and the written tables of this.

    If any prefix is split, the third table has the longer ones that are found
    there (level, key, split). They are counted in the tasks, up to `summed` of
    them at a time, so that copies add up before they travel.
    """
    documents = versions(documents)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4_000_000):
            w = Windows(part, window)
            key = w.keys(0, np.arange(len(w.positions)))
            at, _ = w.runs(key, np.arange(len(key)))
            yield _counts(0, key[at], w.docs[at], part)

    def longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in blocks(batches, "text", 4_000_000):
            w = Windows(part.select([0, 1]), window)
            split = np.unique(pc.list_flatten(part.column(3)).to_numpy(zero_copy_only=False)).view(np.uint64)
            which = np.flatnonzero(np.isin(w.keys(0, np.arange(len(w.positions))), split))
            for level in range(1, len(w.lengths)):
                key = w.keys(level, which)
                at, _ = w.runs(key, which)
                if len(at):
                    ids = part.column(0).take(pa.array(w.docs[which[at]]))
                    held.append(pa.table([pa.array(np.full(len(at), level, np.int32)), pa.array(key[at].view(np.int64)), ids, ids, pa.array(np.ones(len(at), np.int64))], ["level", "key", "a", "b", "n"]))
            if sum(t.num_rows for t in held) > summed:
                held = _summed(held)
                if held[0].num_rows > summed // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from _summed(held)[0].to_batches()

    rows = stored(documents.mapInArrow(first, COUNTS), "prefixes")
    found = _totals(rows.select("level", "key", F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("n").cast("long").alias("n")), most)
    split = stored(found.where("split").select("level", "key"), "split")
    tables = [rows, split]
    if not split.isEmpty():
        wide = rows.join(split, ["level", "key"]).groupBy(*ROW).agg(F.collect_set("key").alias("split"))
        tables.append(stored(_totals(documents.join(wide, ROW).select("doc_id", "text", "version", "split").mapInArrow(longer, TOTALS), most), "longer"))
    pairs = rows.join(found, ["level", "key"])
    return pairs.groupBy(*ROW).agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("split"), F.col("key"))).alias("split")), tables


def stretches(own: DataFrame, window: int, further: DataFrame | None = None, remembered: int = 400_000) -> DataFrame:
    """From (doc_id, text, version, keys, split), and the longer prefixes (level, key, split) if there are any: stretches of text with n suffixes of one group each.

    Where the task has seen the same stretch in a smaller document, its content
    stays behind: such a row says that all its windows are to be removed.
    """
    filters = None if further is None else (bit_filter(further.select("key")), bit_filter(further.where("split").select("key")))
    held = own.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        shared, again = held.value or (None, None)
        for part in blocks(batches, "text", 4_000_000):
            w = Windows(part.select([0, 1]), window)
            keys, split = (np.unique(pc.list_flatten(part.column(k)).to_numpy(zero_copy_only=False).astype(np.int64)).view(np.uint64) for k in (3, 4))
            group, level = w.grouped(split, again)
            wanted = np.isin(group, keys) & (level == 0)
            if shared is not None:
                wanted |= (level > 0) & flagged(shared, group.view(np.int64))
            which = np.flatnonzero(wanted)
            if not len(which):
                continue
            first, n = w.runs(group[which], which)
            lo = w.positions[which[first]]
            doc = w.docs[which[first]]
            ids, version = (part.column(k).to_numpy(zero_copy_only=False)[doc] for k in (0, 2))
            begin, stop = w.starts[lo].tolist(), w.ends[lo + n + window - 2].tolist()
            raw = w.data.tobytes()
            content: list[bytes | None] = []
            for a, b, d, k in zip(begin, stop, ids.tolist(), n.tolist(), strict=True):
                text = raw[a:b]
                name = xxhash.xxh3_128_digest(text, k)
                had = seen.get(name)
                if had is not None and had < d:
                    content.append(None)
                    continue
                content.append(text)
                seen[name] = d
            if len(seen) > remembered:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(group[which[first]].view(np.int64)), pa.array(ids), pa.array(version), pa.array((lo - w.word_at[:-1][doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(content, pa.binary())], NAMES)

    return own.mapInArrow(run, FRONT)


def suffix_tree(symbols: np.ndarray, ends: np.ndarray, least: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The tree as the order of its suffixes and, before each, how many symbols it has in common with its neighbour.

    Common prefixes shorter than `least` are given as 0. Without `whole` the tree
    ends at that depth.
    """
    depth = int((ends - np.arange(len(ends))).max(initial=0)) if whole else least
    order, _ = suffix_array(symbols, ends, max(depth, least))
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        room = np.minimum(ends[a] - a, ends[b] - b)
        alive, reach = np.flatnonzero(room >= least), 0
        while len(alive) and reach < depth:
            alive = alive[symbols[a[alive] + reach] == symbols[b[alive] + reach]]
            reach += 1
            if reach >= least:
                common[alive + 1] = reach
            alive = alive[room[alive] > reach]
    return order, common


def maximal_repeats(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int) -> list[tuple[int, list[int]]]:
    """(length, places) of the tree's inner nodes of that depth whose suffixes don't all have the same symbol before them.

    begins[i] and ends[i] bound the text of position i.
    """
    order, common = suffix_tree(symbols, ends, least)
    before = np.where(order > begins[order], symbols[np.maximum(order - 1, 0)], np.uint64(0))
    found, stack = [], []  # of (depth, first place in the order)
    for i in range(1, len(order) + 1):
        depth, first = int(common[i]) if i < len(order) else 0, i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            own = before[first:i]
            if (own == 0).any() or (own != own[0]).any():
                found.append((d, sorted(order[first:i].tolist())))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return found


def repeated(docs: np.ndarray, version: np.ndarray, start: np.ndarray, n: np.ndarray, content: pa.Array, window: int) -> tuple[np.ndarray, ...]:
    """Runs (doc, version, start, n) of the suffixes whose first `window` words also start in a smaller document of these stretches."""
    data, at = utf8(content)
    begin, stop, word_at = words(data, at, BLANKS)
    symbols = word_hashes(data, begin, stop)
    sizes = np.diff(word_at)
    order, common = suffix_tree(symbols, np.repeat(word_at[1:], sizes), window, whole=False)
    piece = np.repeat(np.arange(len(n)), sizes)
    offset = np.arange(len(symbols)) - word_at[:-1][piece]
    node = np.cumsum(common == 0)
    inside = offset[order] < n[piece[order]]
    order, node = order[inside], node[inside]
    if not len(order):
        return docs[:0], version[:0], start[:0], n[:0]
    own = docs[piece[order]]
    head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    least = np.minimum.reduceat(own, head)
    gone = np.sort(order[own > np.repeat(least, np.diff(np.append(head, len(order))))])
    if not len(gone):
        return docs[:0], version[:0], start[:0], n[:0]
    cut = np.flatnonzero(np.r_[True, (gone[1:] != gone[:-1] + 1) | (piece[gone][1:] != piece[gone][:-1])])
    p = piece[gone[cut]]
    return docs[p], version[p], (start[p] + offset[gone[cut]]).astype(np.int32), np.diff(np.append(cut, len(gone))).astype(np.int32)


def removals(front: DataFrame, window: int, words_held: int = 1_500_000) -> DataFrame:
    """(doc_id, version, start, n): runs of windows to remove. Stretches with content are dealt out and sorted by group; the others need no group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(table: pa.Table) -> pa.RecordBatch:
            c = table.column("content").combine_chunks()
            return pa.RecordBatch.from_arrays(list(map(pa.array, repeated(*(table.column(k).to_numpy() for k in NAMES[1:5]), c, window))), NAMES[1:5])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += pc.sum(batch.column(4)).as_py() + window * batch.num_rows
            if size >= words_held:
                table = pa.Table.from_batches(held)
                keys = table.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield flush(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = pc.sum(table.slice(cut).column(4)).as_py() + window * (len(keys) - cut)
        if held:
            yield flush(pa.Table.from_batches(held))

    known = front.where("content is null").select(*ROW, "start", "n")
    return front.where("content is not null").repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, version long, start int, n int").unionByName(known)


REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def without_repeats(documents: DataFrame, window: int = 50, most: int = 2_000, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with_text) kept: the words left, joined by one space.

    A word is removed if it is in a window of `window` words of its document
    whose words also start in a document of smaller doc_id. Null texts have no
    words; a document without a doc_id is left whole and removes nothing. Rows
    that share a doc_id are one document to the others, don't remove words from
    one another, and are each judged and reported by their own text.
    """
    spark = documents.sparkSession
    ship(spark)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = own.where("doc_id is not null")
    wanted, tables = partitions(named, window, most)
    front = stored(stretches(versions(named).join(wanted, ROW).select("doc_id", "text", "version", "keys", "split"), window, *tables[2:]), "stretches")
    runs = F.collect_set(F.struct("start", "n"))
    gone = stored(removals(front, window).groupBy(*ROW).agg(runs.alias("runs")).select(*ROW, F.col("runs.start").alias("starts"), F.col("runs.n").alias("ns")), "removals")
    for table in (front, *tables):
        drop(spark, table)
    # of the texts only those that lose words travel, and some that a filter of fixed size takes for such
    flags = spark.sparkContext.broadcast(bit_filter(gone.select("version")))

    def maybe(part: pa.RecordBatch) -> np.ndarray:
        return flagged(flags.value, part.column(2).to_numpy(zero_copy_only=False)) & part.column(0).is_valid().to_numpy(zero_copy_only=False)

    def travelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4_000_000):
            yield part.filter(pa.array(maybe(part)))

    def staying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4_000_000):
            part = part.filter(pa.array(~maybe(part))).select([0, 1])
            lists = pa.array([[]] * part.num_rows, pa.list_(pa.int32()))
            yield from run(iter([part.append_column("starts", lists).append_column("ns", lists)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4_000_000):
            n_words, n_removed, digest, kept = [], [], [], []
            for text, starts, ns in zip(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                parts = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n_words.append(len(parts))
                if starts:
                    edge = np.zeros(len(parts) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.add(starts, ns) + window - 1, -1)
                    parts = [w for w, x in zip(parts, (np.cumsum(edge)[:-1] == 0).tolist(), strict=True) if x]
                left = b" ".join(parts)
                n_removed.append(n_words[-1] - len(parts))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_text else None)
            kept_column = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest), kept_column], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    every = versions(own)
    lost = every.mapInArrow(travelling, "doc_id long, text string, version long").join(gone, ROW, "left").select("doc_id", "text", "starts", "ns")
    joined = lost.mapInArrow(run, REPORT).unionByName(every.mapInArrow(staying, REPORT))
    return joined if with_text else joined.drop("kept")
