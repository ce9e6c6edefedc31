"""Hierarchical multi-length packing of tokenised documents into training sequences.

A document gives full windows of the longest tier; its rest goes to the
shortest tier that holds it. Each tier's windows take the longest rests first,
then whole rests of the same or shorter tiers that fit the gap best, and at last
the front of a rest, so that they have no padding. Only the last tokens of a
pool are cut into lengths that are powers of two. Sequences of a tier are dealt
to step groups of equal token count so that their attention costs balance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import blocks, ship
from .tokens import chunks

TIERS = (512, 1024, 2048, 4096)
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

#: A piece: document, start, length.
Piece = tuple[int, int, int]


class Rests:
    """Pieces shorter than the longest window, by length; bit n of `present` tells whether one of length n is left."""

    def __init__(self, pieces: list[Piece]):
        self.by: dict[int, list[Piece]] = {}
        self.present = 0
        for p in pieces:
            self.add(p)

    def add(self, piece: Piece) -> None:
        self.by.setdefault(piece[2], []).append(piece)
        self.present |= 1 << piece[2]

    def take(self, length: int) -> Piece:
        own = self.by[length]
        piece = own.pop()
        if not own:
            self.present ^= 1 << length
        return piece

    def longest(self, most: int) -> int:
        """The largest length left of at most `most`, or 0."""
        return max(0, (self.present & ((2 << most) - 1)).bit_length() - 1)

    def shortest(self, least: int) -> int:
        """The smallest length left of at least `least`, or 0."""
        above = self.present >> least << least
        return (above & -above).bit_length() - 1 if above else 0


def pack(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces for documents of these token counts; every length is a tier or a power of two."""
    top = tiers[-1]
    out: list[list[Piece]] = []
    rests = []
    for d, n in enumerate(sizes):
        out.extend([(d, s, top)] for s in range(0, n - n % top, top))
        if n % top:
            rests.append((d, n - n % top, n % top))
    left = Rests(rests)
    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[k - 1] if k else 0
        while left.longest(tier) > below:
            row, gap = [], tier
            while gap and left.present:
                if fit := left.longest(gap):
                    row.append(left.take(fit))
                    gap -= fit
                else:
                    d, s, n = left.take(left.shortest(gap))
                    row.append((d, s, gap))
                    left.add((d, s + gap, n - gap))
                    gap = 0
            if gap:
                out.extend(powers_of_two(row, tier - gap))
            else:
                out.append(row)
    return out


def powers_of_two(row: list[Piece], total: int) -> Iterator[list[Piece]]:
    """The row cut into sequences whose lengths are the powers of two in `total`, longest first."""
    todo = list(reversed(row))
    for b in range(total.bit_length() - 1, -1, -1):
        if total >> b & 1:
            want, own = 1 << b, []
            while want:
                d, s, n = todo.pop()
                if n > want:
                    todo.append((d, s + want, n - want))
                    n = want
                own.append((d, s, n))
                want -= n
            yield own


def step_groups(sequences: list[list[Piece]], tiers: tuple[int, ...], tokens: int) -> tuple[list[int], list[int]]:
    """Tier and step group of each sequence: groups of `tokens` tokens of one tier, dealt back and forth by attention cost."""
    tier = [next((t for t in tiers if t >= sum(p[2] for p in row)), tiers[-1]) for row in sequences]
    group, used = [0] * len(sequences), 0
    for t in tiers:
        own = sorted((i for i, x in enumerate(tier) if x == t), key=lambda i: -sum(p[2] ** 2 for p in sequences[i]))
        n = -(-len(own) * t // tokens)
        for rank, i in enumerate(own):
            turn, place = divmod(rank, n)
            group[i] = used + (place if turn % 2 == 0 else n - 1 - place)
        used += n
    return tier, group


def packed(documents: DataFrame, tokenizer: str, end_id: int = 2, keeps_blanks: bool = False, tiers: tuple[int, ...] = TIERS, pool_tokens: int = 1 << 22, step_tokens: int = 1 << 15) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, its checksum, tier and step group.

    Tasks pack what they read in pools of about pool_tokens ids, so nothing is
    shuffled. A null text is empty and gives its end id alone; repeated rows are
    packed as often as they stand. Other columns are ignored.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunks(tokenizer, keeps_blanks)
        first_sequence = first_group = TaskContext.get().partitionId() << 40
        docs: list[int | None] = []
        tokens: list[memoryview] = []

        def rows() -> pa.RecordBatch:
            nonlocal first_sequence, first_group
            sequences = pack([len(t) // 4 for t in tokens], tiers)
            tier, group = step_groups(sequences, tiers, step_tokens)
            out = []
            for i, row in enumerate(sequences):
                offset = 0
                for d, s, n in row:
                    out.append((docs[d], s, n, zlib.crc32(tokens[d][4 * s : 4 * (s + n)]), len(tokens[d]) // 4, first_sequence + i, offset, tier[i], first_group + group[i]))
                    offset += n
            first_sequence += len(sequences)
            first_group += max(group, default=-1) + 1
            names = [f.split()[0] for f in PACKED.split(", ")]
            kinds = [pa.int32() if n == "tier" else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        held = 0
        for batch in blocks(batches, "text", 8_000_000):
            docs.extend(batch.column(0).to_pylist())
            ids, at = encoder.encode(batch.column(1), end_id)
            raw, edges = memoryview(ids.astype("<u4").tobytes()), (4 * at).tolist()
            tokens.extend(raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))
            held += len(ids)
            if held >= pool_tokens:
                yield rows()
                docs, tokens, held = [], [], 0
        if docs:
            yield rows()

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, PACKED)
