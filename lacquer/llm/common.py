"""What the operators share: scratch tables, code shipping, and Arrow text as numpy bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scratch import drop as drop, scratch as scratch, stored as stored
from ..functions.ship import ship as ship


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat, at - at[0]


def cut(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose column has about `most` bytes; a longer row stays whole."""
    _, at = utf8(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = hi


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """All batches of a task, cut."""
    for batch in batches:
        yield from cut(batch, column, most)
    give_back()


def give_back() -> None:
    """Return freed memory to the system at the end of a task: its worker goes on to other tasks, and the executor needs it too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such function in this C library
        pass


def word_table(separators: bytes) -> np.ndarray:
    """256 flags: whether a byte belongs to a word."""
    flags = np.ones(256, bool)
    flags[np.frombuffer(separators, np.uint8)] = False
    return flags


#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = word_table(b" \t\n\x0b\x0c\r")
#: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = word_table(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def words(data: np.ndarray, at: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the rows' bytes, and n + 1 word offsets of the rows."""
    inside = flags[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = at[1:] > at[:-1]
        heads, tails = at[:-1][full], at[1:][full] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


_MULT = np.uint64(0x9E3779B97F4A7C15)
_BACK = pow(int(_MULT), -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept per process for the block sizes in use."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if len(have) <= 1 << 20:  # larger ones would stay in every worker
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, never 0."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return np.where(x == 0, np.uint64(1), x)


def rolling(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[lo:hi] for every pair, by one running sum of a polynomial."""
    n = len(values)
    rising = powers(_MULT, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * rising[:n], dtype=np.uint64, out=total[1:])
    # dividing by the power at lo is multiplying by that at n - lo and dividing by that at n
    return mix((total[hi] - total[lo]) * rising[n - lo] * np.uint64(pow(_BACK, n, 1 << 64)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; equal words have equal hashes in every process."""
    return rolling(_BYTES[data], starts, ends)


MOST_BITS = 1 << 25


def bit_filter(keys: DataFrame) -> np.ndarray:
    """Flags set at the hashes of a long column, packed: 16 bits a key, at most 4 MB whatever their number. Flags of others only cost time."""
    n = min(MOST_BITS, 1 << max(10, (16 * keys.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slots(batch.column(0).drop_null().to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["cell", "bits"])

    cells = keys.mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    flags = np.zeros(n >> 5, np.uint32)
    flags[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().astype(np.uint32)
    return flags


def _slots(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) * _MULT) & np.uint64(n - 1)).astype(np.int64)


def flagged(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _slots(keys, 32 * len(flags))
    return (flags[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
