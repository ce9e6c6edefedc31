"""Token ids in files of static range asymmetric numeral system (rANS) segments.

A segment holds whole documents in ascending doc_id order: one frequency table
shared by all its blocks, a checkpoint for each block (tokens, byte offset, lane
states, checksum), and a directory of documents. Blocks are coded independently
and each interleaves many lanes, so that both tasks and vectors decode in
parallel. Segments are rows of a Parquet table, which gives any store that Spark
can write, and atomic commits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import blocks, scratch, ship
from .tokens import chunks

MAGIC, VERSION, BITS = b"RTOK", 1, 16
BLOCK, LANES = 1 << 18, 1024
HEAD = struct.Struct("<4sHHIIIIII")
POINT = struct.Struct("<IIQIII")
#: Stands for all ids beyond the most frequent 2 ** 16 - 1 of a segment; they follow their block's words as they are.
RARE = np.uint32(0xFFFFFFFF)
LOW = np.uint64(1 << BITS)


def table_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and their frequencies, each 1 at least, that add up to 2 ** 16."""
    symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << BITS:
        by = np.argsort(-counts, kind="stable")
        kept, rest = np.sort(by[: (1 << BITS) - 1]), by[(1 << BITS) - 1 :]
        symbols, counts = np.append(symbols[kept], RARE), np.append(counts[kept], counts[rest].sum())
    freq = np.maximum(1, (counts.astype(np.int64) << BITS) // max(1, counts.sum()))
    by = np.argsort(-freq, kind="stable")
    spare = (1 << BITS) - int(freq.sum())
    if spare > 0 and len(freq):
        freq[by[0]] += spare
    while spare < 0:
        wide = by[freq[by] > 1]
        take = np.minimum(freq[wide] - 1, -(spare // len(wide)))
        take = np.where(np.cumsum(take) <= -spare, take, np.maximum(0, -spare - (np.cumsum(take) - take)))
        freq[wide] -= take
        spare += int(take.sum())
    return symbols.astype(np.uint32), freq


def encode_block(slots: np.ndarray, freq: np.ndarray, base: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code positions of the table; token t is in lane t % lanes. Returns the words and the lanes' final states."""
    lanes = max(1, min(LANES, len(slots) // 64))
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    f, c = freq[slots], base[slots]
    limit = f << np.uint64(BITS)
    for lo in range((len(slots) - 1) // lanes * lanes, -1, -lanes):
        hi = min(lo + lanes, len(slots))
        x, fs = state[: hi - lo], f[lo:hi]
        full = x >= limit[lo:hi]
        words.append(x[full].astype("<u2"))
        x = np.where(full, x >> np.uint64(16), x)
        q = x // fs
        state[: hi - lo] = (q << np.uint64(BITS)) + (x - q * fs) + c[lo:hi]
    return b"".join(w.tobytes() for w in reversed(words)), state.astype("<u4")


def decode_block(words: np.ndarray, state: np.ndarray, n: int, freq: np.ndarray, base: np.ndarray, slot_of: np.ndarray) -> np.ndarray:
    """The table positions of n tokens. Raises ValueError if the lanes don't end where coding began."""
    lanes, at = len(state), 0
    state = state.astype(np.uint64)
    out = np.empty(n, np.uint32)
    for lo in range(0, n, lanes):
        hi = min(lo + lanes, n)
        x = state[: hi - lo]
        low = x & np.uint64(0xFFFF)
        s = slot_of[low]
        out[lo:hi] = s
        x = freq[s] * (x >> np.uint64(BITS)) + low - base[s]
        need = np.flatnonzero(x < LOW)
        if at + len(need) > len(words):
            raise ValueError("a block is damaged")
        x[need] = (x[need] << np.uint64(16)) | words[at : at + len(need)]
        at += len(need)
        state[: hi - lo] = x
    if at != len(words) or (state != LOW).any():
        raise ValueError("a block is damaged")
    return out


def encode_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment of whole documents with so many ids each."""
    symbols, freq = table_of(ids)
    f, base = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    slots = np.searchsorted(symbols, ids).clip(max=max(0, len(symbols) - 1))
    rare = symbols[slots] != ids
    slots[rare] = len(symbols) - 1
    points, body, at = [], [], 0
    for lo in range(0, len(ids), BLOCK):
        own = slice(lo, min(lo + BLOCK, len(ids)))
        words, state = encode_block(slots[own], f, base)
        plain = ids[own][rare[own]].astype("<u4").tobytes()
        part = state.tobytes() + words + plain
        points.append(POINT.pack(own.stop - lo, len(state), at, len(part), len(plain) // 4, zlib.crc32(ids[own].astype("<u4").tobytes())))
        body.append(part)
        at += len(part)
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes())
    directory = zlib.compress(
        np.array([d is not None for d in doc_ids], "u1").tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + sizes.astype("<u4").tobytes()
    )
    head = HEAD.pack(MAGIC, VERSION, BITS, len(doc_ids), len(symbols), len(table), len(directory), len(points), zlib.crc32(table + directory + b"".join(points)))
    return b"".join((head, table, directory, *points, *body))


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, tokens of each, and all ids of a segment. Raises ValueError if a checksum doesn't hold."""
    magic, version, _, n_docs, n_symbols, n_table, n_dir, n_points, check = HEAD.unpack_from(data)
    a = HEAD.size
    b, c = a + n_table, a + n_table + n_dir
    d = c + n_points * POINT.size
    if magic != MAGIC or version != VERSION or zlib.crc32(data[a:d]) != check:
        raise ValueError("not a segment, or its head is damaged")
    table = np.frombuffer(zlib.decompress(data[a:b]), "<u4")
    symbols, freq = np.cumsum(table[:n_symbols], dtype=np.uint32), table[n_symbols:].astype(np.uint64)
    base = np.cumsum(freq) - freq
    slot_of = np.repeat(np.arange(n_symbols, dtype=np.uint32), freq.astype(np.int64))
    raw = zlib.decompress(data[b:c])
    valid = np.frombuffer(raw, "u1", n_docs)
    doc_ids = np.frombuffer(raw, "<i8", n_docs, n_docs).tolist()
    sizes = np.frombuffer(raw, "<u4", n_docs, 9 * n_docs)
    ids = [np.zeros(0, np.uint32)]
    for k in range(n_points):
        n, lanes, at, length, n_rare, crc = POINT.unpack_from(data, c + k * POINT.size)
        state = np.frombuffer(data, "<u4", lanes, d + at)
        words = np.frombuffer(data, "<u2", (length - 4 * lanes - 4 * n_rare) // 2, d + at + 4 * lanes).astype(np.uint64)
        part = symbols[decode_block(words, state, n, freq, base, slot_of)]
        if n_rare:
            place = np.flatnonzero(part == RARE)
            if len(place) != n_rare:
                raise ValueError(f"block {k} is damaged")
            part[place] = np.frombuffer(data, "<u4", n_rare, d + at + length - 4 * n_rare)
        if zlib.crc32(part.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        ids.append(part)
    return [x if v else None for x, v in zip(doc_ids, valid, strict=True)], sizes, np.concatenate(ids)


WRITTEN = "part int, segment long, n_docs long, n_tokens long, data binary"


def write(documents: DataFrame, path: str, tokenizer: str, keeps_blanks: bool = True, end_id: int = 0, segment_tokens: int = 1 << 21) -> None:
    """Write the ids of all texts, end_id after each document, in ascending doc_id order.

    Null texts are empty; a null doc_id comes first; documents of equal doc_id
    follow one another, and repeated rows are each written. Other columns are
    ignored. A segment closes at the first batch that brings it to segment_tokens.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, segment, held = chunks(tokenizer, keeps_blanks), TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            data = encode_segment(doc_ids, np.concatenate(sizes), np.concatenate(ids))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, segment, len(doc_ids), held, data), kinds, strict=True)], ["part", "segment", "n_docs", "n_tokens", "data"])

        for batch in blocks(batches, "text", 8_000_000):
            new, at = encoder.encode(batch.column(1), end_id)
            doc_ids += batch.column(0).to_pylist()
            sizes.append(np.diff(at))
            ids.append(new)
            held += len(new)
            if held >= segment_tokens:
                yield row()
                doc_ids, sizes, ids, held, segment = [], [], [], 0, segment + 1
        if doc_ids:
            yield row()

    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, WRITTEN).write.option("compression", "none").parquet(path)


READ = "part int, segment long, doc_id long, local long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids before it in the whole corpus), n_tokens and ids_crc32."""
    ship(spark)
    files = spark.read.schema(WRITTEN).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids, sizes, ids = decode_segment(data.as_buffer().to_pybytes())
                raw, stops = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes, dtype=np.int64)
                crcs = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), sizes.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([segment] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(stops - sizes, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())],
                    ["part", "segment", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    # sums of the parts before, then of the part's segments before: neither moves documents
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = files.select("part", "segment", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")).alias("segment_start"))
    starts = inside.join(before, "part")
    rows = files.select("part", "segment", "data").mapInArrow(run, READ)
    return rows.join(starts, ["part", "segment"]).select("doc_id", (F.col("part_start") + F.col("segment_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    path = scratch(documents.sparkSession, "tokens")
    write(documents, path, tokenizer)
    return read(documents.sparkSession, path)
