"""Near-duplicates by verified similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Equal sets are one node. Candidates are the links of operator 9: fingerprints of
the sets (SimHash) within 4 bits, found by its partitions, thresholds and probes.
Sets of a similarity near 0.8 are further apart, so that there are candidates by
minima as well: those of 64 hash functions over a set, in 16 bands of 4, put nodes
into buckets; two of similarity s share one with probability 1 - (1 - s^4)^16,
0.9998 at 0.8, and are candidates if they agree in enough of all 64 minima. What
candidates join, directly or through others, is a group; the texts of a group, and
of no other node, travel once to be compared as whole sets. All steps hand on
spanning forests, not pairs. Of the documents that links join, the one of the
smallest doc_id stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, LOWER, bit_filter, blocks, cut, drop, flagged, give_back, mix, rolling, ship, stored, utf8, word_hashes, words
from .components import components, linked
from .simhash import links as within, majorities

BANDS, ROWS = 16, 4
_FLIPS, _ODDS = np.random.default_rng(20240301).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's shingles, ascending, and the n + 1 offsets of the texts; a text of fewer words is one shingle."""
    data, at = utf8(column)
    data = LOWER[data]
    starts, ends, word_at = words(data, at, BLANKS)
    symbols = word_hashes(data, starts, ends)
    n_words = np.diff(word_at)
    n = np.where(n_words > 0, np.maximum(1, n_words - width + 1), 0)
    first = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    lo = word_at[:-1][doc] + np.arange(len(doc)) - first[doc]
    hashes = rolling(symbols, lo, np.minimum(lo + width, word_at[1:][doc])) if len(lo) else np.zeros(0, np.uint64)
    by = np.lexsort((hashes, doc))
    doc, hashes = doc[by], hashes[by]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])][: len(doc)]
    return hashes[new], np.r_[0, np.cumsum(np.bincount(doc[new], minlength=len(n)))].astype(np.int64)


def minima(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each nonempty set its bucket in every band, and 8 bits of each minimum."""
    full = at[:-1][at[1:] > at[:-1]]
    out, bits = np.zeros((len(full), BANDS), np.uint64), np.zeros((len(full), BANDS * ROWS), np.uint8)
    for k in range(BANDS if len(full) else 0):
        out[:, k] = np.uint64(k + 1)
        for j in range(k * ROWS, (k + 1) * ROWS):
            low = np.minimum.reduceat((sets ^ _FLIPS[j]) * _ODDS[j], full)
            bits[:, j] = mix(low) & np.uint64(255)
            out[:, k] = mix(out[:, k] * np.uint64(31) + low)
    return out, bits


def buckets(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bucket of each nonempty set in every band."""
    return minima(sets, at)[0]


def enough(least: float) -> int:
    """Minima that two sets of this similarity have in common, but for five standard deviations (odds of about one in a million to have fewer)."""
    n = BANDS * ROWS
    return int(n * least - 5 * (n * least * (1 - least)) ** 0.5)


def agreeing(bits: np.ndarray, q: int, left: np.ndarray, wanted: int) -> np.ndarray:
    """Which of the sets `left` have at least so many minima in common with set q."""
    return (bits[left] == bits[q]).sum(1, dtype=np.uint8) >= wanted


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, np.ndarray]]:
    """Edges of a spanning forest of n nodes: from each node reached, all that it reaches first. near(q, left) flags those of left with an edge to q."""
    left, out = np.arange(n), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            q = queue.pop()
            hit = near(q, left)
            if hit.any():
                new = left[hit]
                out.append((q, new))
                queue.extend(new.tolist())
                left = left[~hit]
    return out


def forest(sets: np.ndarray, at: np.ndarray, ids: np.ndarray, least: float, bits: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links of sets; with their minima's bits only sets that agree in enough of them are compared."""
    _, symbols = np.unique(sets, return_inverse=True)
    sizes, own = np.diff(at), np.zeros(int(symbols.max(initial=-1)) + 1, bool)
    wanted = enough(least)

    def near(q: int, left: np.ndarray) -> np.ndarray:
        hit = np.ones(len(left), bool) if bits is None else agreeing(bits, q, left, wanted)
        some = np.flatnonzero(hit)
        n = sizes[left[some]]
        if not n.sum():
            hit[some] = False
            return hit
        full = some[n > 0]
        hit[some[n == 0]] = False
        n = sizes[left[full]]
        flat = symbols[np.repeat(at[:-1][left[full]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        own[symbols[at[q] : at[q + 1]]] = True
        shared = np.add.reduceat(own[flat], np.cumsum(n) - n, dtype=np.int64)
        own[symbols[at[q] : at[q + 1]]] = False
        hit[full] = shared >= least * (sizes[q] + n - shared) - 1e-9
        return hit

    return [(np.full(len(new), ids[q]), ids[new]) for q, new in spanning(len(ids), near)]


def by_cell(rows: DataFrame, key: list[str], edges: Callable[[pa.Table], list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Edges (u, v) that a function finds in each cell (key and cell, both longs) of rows, which a task takes one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def keys(table: pa.Table) -> np.ndarray:
            return np.vstack([table.column(k).to_numpy() for k in range(len(key) + 1)])

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            k = keys(table)
            head = np.flatnonzero(np.r_[True, (k[:, 1:] != k[:, :-1]).any(0)]).tolist()
            for a, b in zip(head, [*head[1:], table.num_rows], strict=True):
                if b - a > 1 and (some := edges(table.slice(a, b - a))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[i] for e in some])) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            k = keys(table)
            new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0))
            if len(new):
                last = int(new[-1]) + 1
                yield from found(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))
        give_back()

    return rows.repartition(*key, "cell").sortWithinPartitions(*key, "cell").mapInArrow(run, "u long, v long")


def _bits(table: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def candidates(cells: DataFrame, least: float) -> DataFrame:
    """Edges whose closure is that of all candidates of each cell of rows (bucket, cell, id, bits)."""
    wanted = enough(least)

    def edges(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        ids, bits = table.column("id").to_numpy(), _bits(table, "bits")
        return [(np.full(len(new), ids[q]), ids[new]) for q, new in spanning(len(ids), lambda q, left: agreeing(bits, q, left, wanted))]

    return by_cell(cells.select("bucket", "cell", "id", "bits"), ["bucket"], edges)


def alike(nodes: DataFrame, distance: int) -> DataFrame:
    """Edges whose closure is that of all pairs of nodes (id, fp) with fingerprints within the distance, by operator 9's search; equal ones are joined by a star."""
    own = stored(nodes.groupBy("fp").agg(F.min("id").alias("id")), "fingerprints")
    equal = nodes.join(own.select("fp", F.col("id").alias("v")), "fp").where("id <> v").select(F.col("id").alias("u"), "v")
    return equal.unionByName(within(own, distance))


def links(cells: DataFrame, width: int, least: float) -> DataFrame:
    """Edges whose closure is that of all links of each cell of rows (group, cell, id, bits, text)."""

    def edges(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        parts = [shingles(part.column(0), width) for batch in table.select(["text"]).to_batches() for part in cut(batch, "text", 4_000_000)]
        sets, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([np.diff(p[1]) for p in parts])
        return forest(sets, np.r_[0, np.cumsum(sizes)], table.column("id").to_numpy(), least, _bits(table, "bits"))

    return by_cell(cells.select("group", "cell", "id", "bits", "text"), ["group"], edges)


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """From (doc_id, text, version): doc_id, version, the bytes of the text, node (a hash of its shingle set), the set's fingerprint, its buckets and bits of its minima."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "text", 4_000_000):
            sets, at = shingles(part.column(1), width)
            nodes = rolling(sets, at[:-1], at[1:]) if len(sets) else np.ones(part.num_rows, np.uint64)
            full = np.r_[0, np.cumsum(at[1:] > at[:-1])]
            own, bits = minima(sets, at)
            lists = pa.ListArray.from_arrays(pa.array(BANDS * full, pa.int32()), pa.array(own.ravel().view(np.int64)))
            raw, places = bits.tobytes(), BANDS * ROWS * full
            binary = pa.array([raw[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)], pa.binary())
            sizes = pa.array(np.diff(utf8(part.column(1))[1]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), sizes, pa.array(nodes.view(np.int64)), pa.array(majorities(sets, at).view(np.int64)), lists, binary], ["doc_id", "version", "size", "node", "fp", "hashes", "bits"])

    return documents.mapInArrow(run, "doc_id long, version long, size long, node long, fp long, hashes array<long>, bits binary")


def _flagged(rows: DataFrame, flags, hit: bool) -> DataFrame:
    """The rows whose version a broadcast bit filter takes for one of its own, or those it does not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("version")).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(flagged(flags.value, at) == hit))

    return rows.mapInArrow(run, rows.schema)


def version() -> Column:
    """What tells rows apart: a hash of doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def deduplicate(documents: DataFrame, width: int = 5, least: float = 0.8, most: int = 2_000, held: int = 16_000, distance: int = 4) -> DataFrame:
    """All columns of the documents but those that links of this similarity join, directly or through others, to one of smaller doc_id.

    Each row is judged by its own text, whatever other rows its doc_id has. Of a
    group the row of the smallest doc_id stays, and rows that repeat it; rows
    with a null doc_id stay; texts without words are one group. A bucket of over
    `most` sets, and a group of over `most` texts or `most * held` bytes of them,
    is dealt out in blocks (components.linked), so that no task holds more than
    some two blocks of one.
    """
    spark = documents.sparkSession
    texts = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), version().alias("version"))
    own = stored(sketches(texts, width), "sketches")
    first = F.min_by(F.struct("doc_id", "version", "size", "fp", "hashes", "bits"), F.struct("doc_id", "version"))
    nodes = stored(own.groupBy("node").agg(first.alias("first")).select(F.col("node").alias("id"), "first.*"), "nodes")
    rows = nodes.select("id", "bits", F.explode("hashes").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    live = stored(rows.join(sizes, "bucket"), "buckets")
    banded = linked(live, ["bucket"], lambda cells: candidates(cells, least), most, live.agg(F.max("n")).first()[0] or 0)
    # texts without words are one node, alike to no other
    found = components(alike(nodes.where(F.size("hashes") > 0).select("id", "fp"), distance).unionByName(banded))
    joined = nodes.join(found.select(F.col("node").alias("id"), F.col("component").alias("group")), "id").select("id", "bits", "version", "size", "group")
    weight = F.greatest(F.count("*"), F.ceil(F.sum("size") / held)).alias("n")
    wanted = stored(joined.join(joined.groupBy("group").agg(weight), "group"), "wanted")
    flags = spark.sparkContext.broadcast(bit_filter(wanted.select("version")))
    # a row's text is that of its version: rows that repeat one give it once
    held_texts = _flagged(texts.select("text", "version"), flags, True).join(wanted, "version").groupBy("version").agg(*(F.first(c).alias(c) for c in ("id", "group", "n", "bits", "text")))
    compared = stored(held_texts, "texts")
    linked_nodes = components(linked(compared, ["group"], lambda cells: links(cells, width, least), most, compared.agg(F.max("n")).first()[0] or 0))
    named = nodes.join(linked_nodes.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    best = named.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("best"))
    staying = named.join(best, "component").select(F.col("id").alias("node"), F.when(F.col("best.id") == F.col("id"), F.col("doc_id")).alias("kept"))
    gone = stored(own.join(staying, "node").where("kept is null or doc_id <> kept").select("version").distinct(), "gone")
    for old in (own, nodes, live, wanted, compared):
        drop(spark, old)
    # of the documents only those that go travel, and some that a filter of fixed size takes for such
    out = spark.sparkContext.broadcast(bit_filter(gone))
    whole = documents.select(F.struct("*").alias("row"), version().alias("version"), F.col("doc_id").isNotNull().alias("named"))
    kept = _flagged(whole, out, True).join(gone.withColumn("named", F.lit(True)), ["version", "named"], "left_anti").select("row").unionByName(_flagged(whole, out, False).select("row"))
    return kept.select("row.*")
