"""Near-duplicate documents by 64-bit SimHash and the generalised pigeonhole principle.

Equal fingerprints are one node. Correlated bits share a partition; a dynamic
programme gives each partition its own threshold so that the thresholds add up
to distance - partitions + 1 at the least estimated cost. Two fingerprints
within the distance are within the threshold of at least one partition, so they
meet in one of its buckets, where they are compared in full. A bucket hands on a
spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, stored
from .components import components, linked

SEED, WIDTH = 42, 64


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the word shingles of one text, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    ones = np.zeros(WIDTH, np.int64)
    raw = np.frombuffer(hashes, np.uint8)
    for lo in range(0, len(raw), 1 << 19):
        ones += np.unpackbits(raw[lo : lo + (1 << 19)]).reshape(-1, WIDTH).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def majorities(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each set hashes[at[i]:at[i + 1]]: a bit is 1 if it is set in over half of the hashes; that of an empty set is 0."""
    sizes = np.diff(at)
    full = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    for bit in range(WIDTH if len(full) else 0):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), at[:-1][full])
        out[full] |= (2 * ones > sizes[full].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(documents: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp, a signed long of the fingerprint's bits. Texts without words, and null ones, have fp 0."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Partitions of bit positions (0 is the lowest) and the threshold of each; -1 skips a partition."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set, summed over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((WIDTH, WIDTH)), 0
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fps)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH * WIDTH + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], ["cell", "n"])

    cells = np.zeros(WIDTH * WIDTH + 1)
    for r in nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r.cell] = r.n
    return int(cells[-1]), cells[:-1].reshape(WIDTH, WIDTH)


def grouped_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of nearly equal size, each grown by the bit that correlates most with those it has."""
    p = both.diagonal() / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(near, 0)
    left, parts = set(range(WIDTH)), []
    for k in range(m):
        size = (WIDTH + k) // m
        rest = sorted(left)
        own = [rest[int(near[np.ix_(rest, rest)].sum(1).argmax())]]
        left.discard(own[0])
        while len(own) < size:
            rest = sorted(left)
            own.append(rest[int(near[np.ix_(rest, own)].sum(1).argmax())])
            left.discard(own[-1])
        parts.append(sorted(own))
    return parts


def probes(width: int, t: int) -> int:
    """Bucket rows of one fingerprint in a partition of this width."""
    return (0, 1, width, width + 1)[t + 1]


#: What a bucket row costs to shuffle, in comparisons of two fingerprints.
ROW_COST = 200.0


def distance_odds(part: list[int], both: np.ndarray, n: int) -> np.ndarray:
    """Of each distance between two fingerprints in this partition, from how often its bits are set, alone and two by two, in all fingerprints.

    Bits that correlate spread the distances: a beta-binomial distribution has
    their mean and variance. Without correlation it is that of independent bits.
    """
    p = both.diagonal()[part] / max(1, n)
    p11 = both[np.ix_(part, part)] / max(1, n)
    p10 = p[:, None] - p11
    p00 = 1 - p[:, None] - p[None, :] + p11
    differ = 2 * p * (1 - p)
    joint = np.where(np.eye(len(part), dtype=bool), differ[:, None], 2 * (p11 * p00 + p10 * p10.T))
    size, share = len(part), float(differ.mean())
    spread = float((joint - np.outer(differ, differ)).sum())
    plain = size * share * (1 - share)
    excess = min(0.999, (spread / plain - 1) / (size - 1)) if plain > 0 and size > 1 else 0.0
    if excess <= 1e-6:
        odds = np.array([1.0])
        for d in differ:
            odds = np.append(odds * (1 - d), 0) + np.append(0, odds * d)
        return odds
    a, b = share * (1 - excess) / excess, (1 - share) * (1 - excess) / excess
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return np.array([exp(lgamma(size + 1) - lgamma(k + 1) - lgamma(size - k + 1) + beta(k + a, size - k + b) - beta(a, b)) for k in range(size + 1)])


def allocate(parts: list[list[int]], both: np.ndarray, n: int, total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds of -1 to 2 that add up to `total` at the least estimated rows and candidates of one fingerprint, and that cost."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for part in parts:
        odds = distance_odds(part, both, n)
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, ts) in best.items():
            for t in (-1, 0, 1, 2):
                # variants of two values within distance 2 of one another meet more than once
                candidates = 0.0 if t < 0 else n * float(odds[: max(t, 2 if t > 1 else t) + 1].sum()) * (1 if t == 0 else 2)
                c = cost + ROW_COST * probes(len(part), t) + candidates
                if used + t not in new or c < new[used + t][0]:
                    new[used + t] = (c, (*ts, t))
        best = new
    return best.get(total, (float("inf"), ()))


def plan(n: int, both: np.ndarray, distance: int) -> Plan:
    """The number of partitions, their bits and their thresholds that cost least for n fingerprints."""
    options = []
    for m in range(max(1, (distance + 1) // 3), distance + 2):
        parts = grouped_bits(both, n, m)
        cost, ts = allocate(parts, both, n, distance - m + 1)
        if ts:
            options.append((cost, Plan(tuple(map(tuple, parts)), ts)))
    return min(options, key=lambda x: x[0])[1]


def masks(p: Plan) -> list[tuple[int, int, int, int]]:
    """(tag, bits kept, bits flipped, partition) of every bucket row of a fingerprint."""
    out = []
    for k, (bits, t) in enumerate(zip(p.parts, p.thresholds, strict=True)):
        whole = sum(1 << b for b in bits)
        if t in (0, 2):
            out.append((256 * k, whole, 0, k))
        if t == 1:  # values that differ in one bit agree on the others
            out.extend((256 * k + 1 + b, whole & ~(1 << b), 0, k) for b in bits)
        if t == 2:  # values that differ in two bits have a neighbour in common
            out.extend((256 * k, whole, 1 << b, k) for b in bits)
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_rows(nodes: DataFrame, p: Plan) -> DataFrame:
    """(tag, value, fp, id): every node once for each bucket it probes."""
    rows = [F.struct(F.lit(tag).alias("tag"), F.col("fp").bitwiseAND(F.lit(signed(keep))).bitwiseXOR(F.lit(signed(flip))).alias("value")) for tag, keep, flip, _ in masks(p)]
    return nodes.select("fp", "id", F.explode(F.array(*rows)).alias("b")).select("b.tag", "b.value", "fp", "id")


def forest(fps: np.ndarray, ids: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links of one bucket: from each one reached, all that it reaches first."""
    out = []
    if len(fps) <= 512:
        close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
        if int(close.sum()) == len(fps):
            return out
    left = np.arange(len(fps))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            q = queue.pop()
            hit = np.bitwise_count(fps[left] ^ fps[q]) <= distance
            new = left[hit]
            if len(new):
                out.append((np.full(len(new), ids[q]), ids[new]))
                queue.extend(new.tolist())
                left = left[~hit]
    return out


def links(nodes: DataFrame, distance: int = 4, most: int = 50_000) -> DataFrame:
    """Edges (u, v) between ids of nodes (fp, id) whose transitive closure is that of all links within the distance.

    A bucket of over `most` fingerprints is dealt out in blocks
    (components.linked), so that no task holds more than some 2 * most of one.
    """
    ship(nodes.sparkSession)
    p = plan(*bit_statistics(nodes), distance)
    rows = bucket_rows(nodes, p)
    sizes = rows.groupBy("tag", "value").agg(F.count("*").alias("n")).where("n > 1")
    live = stored(rows.join(sizes, ["tag", "value"]), "buckets")
    return linked(live, ["tag", "value"], lambda cells: within(cells, distance), most, live.agg(F.max("n")).first()[0] or 0)


def within(cells: DataFrame, distance: int) -> DataFrame:
    """Edges of a spanning forest of the links of each (tag, value, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(t: np.ndarray) -> pa.RecordBatch | None:
            """Of the whole buckets in the columns tag, value, cell, fp, id."""
            new = np.r_[True, (t[:3, 1:] != t[:3, :-1]).any(0)]
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, t.shape[1]])
            found = [e for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True) for e in forest(t[3, a : a + n].view(np.uint64), t[4, a : a + n], distance)]
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([e[k] for e in found])) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.vstack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)]))
            t = np.hstack(held)
            cut = np.flatnonzero((t[:3, 1:] != t[:3, :-1]).any(0))
            if not len(cut):
                held = [t]
                continue
            whole, held = t[:, : cut[-1] + 1], [t[:, cut[-1] + 1 :]]
            if (found := edges(whole)) is not None:
                yield found
        if held and held[0].shape[1] and (found := edges(np.hstack(held))) is not None:
            yield found

    key = ["tag", "value", "cell"]
    return cells.select(*key, "fp", "id").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long")


def clusters(documents: DataFrame, shingle: int = 4, distance: int = 4, most: int = 50_000) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that links reach, itself included.

    Null texts and texts without words share fingerprint 0 and link like any
    other. Repeated rows give repeated rows; a null doc_id gives no component id.
    """
    fps = stored(fingerprints(documents, shingle), "fingerprints")
    nodes = stored(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    found = components(links(nodes, distance, most))
    named = nodes.join(found, nodes.id == found.node, "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    joined = fps.join(named, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(documents: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """All columns of the documents whose doc_id is the smallest of their component; rows with a null doc_id stay, and so do all rows that repeat a doc_id that stays."""
    kept = clusters(documents, shingle, distance).where("doc_id = component_id").select("doc_id").distinct()
    return documents.join(kept, "doc_id", "left_semi").unionByName(documents.where("doc_id is null"))
