"""ISO media containers as a column: build them, walk their boxes, and index their samples.

A text's bytes become 24 x 24 grey frames of 576 one-byte samples in an MP4
track; reading walks the nested boxes, decodes the sample tables and returns
codec, duration and the byte ranges of the key frames. Frames are never decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import blocks, ship, stored

FRAME, RATE, GROUP = 576, 25, 12
#: Boxes that hold boxes, with the bytes of their own fields before those.
PARENTS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"stsd": 8, b"dref": 8}


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
DINF = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
HDLR = full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0")
ENTRY = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 24, 24, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
STSD = full(b"stsd", struct.pack(">I", 1), ENTRY)


def encode(payload: bytes) -> bytes:
    """An MP4 file whose samples are the payload's 576-byte frames, a key frame at every twelfth."""
    n = len(payload) // FRAME
    keys = range(1, n + 1, GROUP)

    def moov(at: int, wide: bool) -> bytes:
        offset = full(b"co64", struct.pack(">IQ", 1, at)) if wide else full(b"stco", struct.pack(">II", 1, at))
        stbl = box(
            b"stbl", STSD, full(b"stts", struct.pack(">III", 1, n, 1)), full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)), full(b"stsz", struct.pack(">II", FRAME, n)), offset,
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), DINF, stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), HDLR, minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", 24 << 16, 24 << 16), flags=7)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    wide = len(payload) > (1 << 32) - (1 << 20) - 4 * len(keys)
    head = len(FTYP) + len(moov(0, wide)) + (16 if 8 + len(payload) >= 1 << 32 else 8)
    return b"".join((FTYP, moov(head, wide), box(b"mdat", payload)))


def walk(data: memoryview, lo: int, hi: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, body start and body end of every box, parents first; a box that runs over its parent ends with it."""
    while hi - lo >= 8:
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1 and hi - lo >= 16:
            size, body = struct.unpack_from(">Q", data, body)[0], lo + 16
        stop = hi if size == 0 else min(hi, lo + size)
        if stop < body:
            return
        yield (*path, kind), body, stop
        if kind in PARENTS and len(path) < 16:
            yield from walk(data, body + PARENTS[kind], stop, (*path, kind))
        lo = stop


def table(data: memoryview, body: int, stop: int, width: str) -> list[tuple[int, ...]]:
    """The rows of a full box that has a count and then rows of the struct `width`; as many as the box holds."""
    if stop - body < 8:
        return []
    n, each = struct.unpack_from(">I", data, body + 4)[0], struct.calcsize(">" + width)
    n = min(n, (stop - body - 8) // each)
    return list(struct.iter_unpack(">" + width, data[body + 8 : body + 8 + n * each]))


def tracks(data: bytes) -> list[dict]:
    """Codec, time scale, duration, sample count and the (start, end) byte ranges of the samples and key frames of each track.

    Samples of movie fragments follow those of the sample tables. Bytes that
    aren't a container give no tracks; a table that is cut off gives the samples
    it still states.
    """
    view, found, own, defaults, moof, part = memoryview(data), [], {}, {}, 0, {}
    for path, body, stop in walk(view, 0, len(data)):
        kind, size = path[-1], stop - body
        if kind == b"trak":
            found.append(own := {"codec": None, "scale": 0, "duration": 0, "id": None, "tables": {}, "runs": []})
        elif kind == b"tkhd" and own and size >= 24:
            own["id"] = struct.unpack_from(">I", view, body + (20 if view[body] == 1 else 12))[0]
        elif kind == b"mdhd" and own and size >= 24:
            long = view[body] == 1 and size >= 36
            own["scale"], own["duration"] = struct.unpack_from(">IQ", view, body + 20) if long else struct.unpack_from(">II", view, body + 12)
        elif len(path) > 1 and path[-2] == b"stsd" and own and own["codec"] is None:
            own["codec"] = kind.decode("latin-1")
        elif len(path) > 1 and path[-2] == b"stbl" and own:
            own["tables"][kind] = (body, stop)
        elif kind == b"trex" and size >= 24:
            track, _, duration, length, flags = struct.unpack_from(">5I", view, body + 4)
            defaults[track] = (duration, length, flags)
        elif kind == b"moof":
            moof = body - 8
        elif kind == b"tfhd" and size >= 8:
            part = fragment_head(view[body:stop], moof, defaults)
        elif kind == b"trun" and part and size >= 8:
            for t in (t for t in found if t["id"] == part["track"]):
                t["runs"] += fragment_run(view[body:stop], part)
    return [samples(view, t) for t in found]


def optional(data: memoryview, at: int, flags: int, fields: tuple[tuple[int, str], ...]) -> tuple[list[int | None], int]:
    """The fields whose flags are set, in order, None for the others and for what is cut off; and where they end."""
    out: list[int | None] = []
    for flag, width in fields:
        if flags & flag and at + struct.calcsize(">" + width) <= len(data):
            out.append(struct.unpack_from(">" + width, data, at)[0])
            at += struct.calcsize(">" + width)
        else:
            out.append(None)
    return out, at


def fragment_head(data: memoryview, moof: int, defaults: dict) -> dict:
    """Track, first byte and sample defaults of a track fragment."""
    flags, track = struct.unpack_from(">II", data)
    (base, _, duration, size, sample_flags), _ = optional(data, 8, flags, ((0x1, "Q"), (0x2, "I"), (0x8, "I"), (0x10, "I"), (0x20, "I")))
    own = defaults.get(track, (0, 0, 0))
    pick = lambda value, k: own[k] if value is None else value
    base = moof if base is None else base
    return {"track": track, "base": base, "next": base, "duration": pick(duration, 0), "size": pick(size, 1), "flags": pick(sample_flags, 2)}


def fragment_run(data: memoryview, part: dict) -> list[tuple[int, int, int, bool]]:
    """(start, end, duration, is a key frame) of the samples of a run."""
    flags, n = struct.unpack_from(">II", data)
    (offset, first_flags), at = optional(data, 8, flags, ((0x1, "i"), (0x4, "I")))
    start = part["next"] if offset is None else part["base"] + offset
    each = 4 * sum(bool(flags & f) for f in (0x100, 0x200, 0x400, 0x800))
    out = []
    # without fields of their own samples take no room, so that only the file's size bounds their number
    for k in range(min(n, (len(data) - at) // each if each else 1 << 20)):
        (duration, size, own_flags, _), at = optional(data, at, flags, ((0x100, "I"), (0x200, "I"), (0x400, "I"), (0x800, "I")))
        size = part["size"] if size is None else size
        state = own_flags if own_flags is not None else first_flags if k == 0 and first_flags is not None else part["flags"]
        out.append((start, start + size, part["duration"] if duration is None else duration, not state & 0x10000))
        start += size
    part["next"] = start
    return out


def samples(view: memoryview, track: dict) -> dict:
    """The sample tables of one track, resolved to byte ranges."""
    where = track.pop("tables")
    read = lambda kind, width: table(view, *where[kind], width) if kind in where else []
    sizes: list[int] = []
    if b"stsz" in where and where[b"stsz"][1] - where[b"stsz"][0] >= 12:
        body, stop = where[b"stsz"]
        fixed, n = struct.unpack_from(">II", view, body + 4)
        sizes = [fixed] * min(n, len(view) // fixed) if fixed else [x for (x,) in struct.iter_unpack(">I", view[body + 12 : body + 12 + 4 * min(n, (stop - body - 12) // 4)])]
    chunks = [x for (x,) in (read(b"co64", "Q") or read(b"stco", "I"))]
    groups = read(b"stsc", "III")
    starts: list[int] = []
    for i, (first, per, _) in enumerate(groups):
        last = groups[i + 1][0] if i + 1 < len(groups) else len(chunks) + 1
        for at in chunks[max(0, first - 1) : max(0, last - 1)]:
            for size in sizes[len(starts) : len(starts) + per]:
                starts.append(at)
                at += size
    ranges = [(a, a + s) for a, s in zip(starts, sizes, strict=False)]
    keys = [x - 1 for (x,) in read(b"stss", "I")] if b"stss" in where else range(len(ranges))
    marked, runs = [ranges[k] for k in keys if 0 <= k < len(ranges)], [r for r in track.pop("runs") if r[1] <= len(view)]
    track["duration"] = track["duration"] or sum(r[2] for r in runs)
    ranges, marked = ranges + [r[:2] for r in runs], marked + [r[:2] for r in runs if r[3]]
    return track | {"samples": len(ranges), "ranges": ranges, "keys": marked, "times": read(b"stts", "II")}


ENCODED = "doc_id long, n_bytes long, media binary"
SCANNED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration double, samples long, keyframes array<struct<start:long,end:long>>, feature string"


def containers(documents: DataFrame) -> DataFrame:
    """doc_id, the text's bytes, and a container of them padded with bytes 255 to a positive multiple of 576; null is empty. Every row has its own, repeated or without id."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4_000_000):
            sizes, media = [], []
            for text in batch.column(1):
                raw = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                sizes.append(len(raw))
                media.append(encode(raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


def index(media: DataFrame) -> DataFrame:
    """Codec, duration, samples, key-frame byte ranges and the payload's digests from the stored bytes of a media column."""
    ship(media.sparkSession)
    names = [f.split()[0] for f in SCANNED.split(", ")]

    def one(doc: int, n: int, data: bytes) -> tuple:
        found = tracks(data)
        t = found[0] if found else {"codec": None, "scale": 0, "duration": 0, "samples": 0, "ranges": [], "keys": []}
        view = memoryview(data)
        lo, hi = (t["ranges"][0][0], t["ranges"][-1][1]) if t["ranges"] else (0, 0)
        payload = view[lo:hi] if hi - lo == sum(b - a for a, b in t["ranges"]) else b"".join(view[a:b] for a, b in t["ranges"])
        seconds = t["duration"] / t["scale"] if t["scale"] else 0.0
        keys = t["keys"]
        feature = f"{t['codec']};{seconds:.2f}s;{t['samples']};" + ",".join(f"{a}-{b}" for a, b in keys)
        return doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), t["codec"], seconds, t["samples"], [{"start": a, "end": b} for a, b in keys], feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        for batch in blocks(batches, "media", 8_000_000):
            rows = [one(d, n, b"" if not m.is_valid else m.as_buffer().to_pybytes()) for d, n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCANNED)


def media_index(documents: DataFrame) -> DataFrame:
    """Store the containers of all texts as a media column in the shared folder and index what was stored."""
    return index(stored(containers(documents), "media"))
