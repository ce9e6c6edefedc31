"""Token files, media containers, packing, archives, the classifier and the pipeline by exact round trips and accuracy."""

import base64
import gzip
import glob
import hashlib
import os
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacquer.llm import media, pack, quality, tokenfile, warc
from lacquer.llm.tokens import Chunks

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def own_ids(path, text, end=None):
    """The whole text by the library itself."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids if text else []
    return np.array(ids + ([] if end is None else [end]), "<u4").tobytes()


@pytest.mark.parametrize(("path", "blanks"), [(BYTES, True), (WORDS, False)])
def test_chunks_equal_whole_texts(path, blanks, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    r = random.Random(4)
    odd = ["".join(r.choice(" \n\t\r.,'sabE!1  \x01\x1cΣς²中 ́") for _ in range(r.randint(0, 30))) for _ in range(2000)]
    odd += ["".join(r.choice(["é", "×", "n", "'", "'s", "7", "<", "\u0338", ".", " ", "\n", "\u00a0", "\u3000", "<|", "endoftext", "|>"]) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    every = [*texts, *odd, "<|endoftext|> a <|endoftext|>b <|startoftext|>", "x ", " x", "a\nb.\nc", "don't, won't.\nI'll", " ", "", "\n"]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in every]

    def split(ids, at):
        return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]

    encoder = Chunks(path, blanks)
    for _ in range(2):  # the second time from what it knows
        assert split(*encoder.encode(pa.array(every, pa.string()))) == want
    assert split(*encoder.encode(pa.array(every, pa.string()).slice(5, 9), 3)) == [w + [3] for w in want[5:14]]
    assert split(*encoder.encode(pa.array([None, "", " "], pa.string()), 3)) == [[3], [3], whole.encode(" ", add_special_tokens=False).ids + [3]]
    assert split(*encoder.encode(pa.array([], pa.string()), 3)) == []
    forgetful = Chunks(path, blanks, remembered=300)
    for lo in range(0, len(every), 97):
        assert split(*forgetful.encode(pa.array(every[lo : lo + 97], pa.string()))) == want[lo : lo + 97]
        assert len(forgetful.known) <= 300 and len(forgetful.flat) == forgetful.sizes.sum()


def test_rans_round_trips():
    r = np.random.default_rng(1)
    cases = [np.zeros(0), np.array([7]), np.full(1000, 50_256), r.integers(0, 50_257, 70_000), np.minimum(r.geometric(0.01, 600_000), 50_000), np.arange(50_257)]
    # more distinct ids than a table has places
    cases += [np.arange(65_536), np.arange(65_537), r.permutation(np.r_[np.arange(200_000), np.zeros(90_000)]), r.integers(0, 1 << 31, 300_000)]
    for ids in cases:
        ids = ids.astype("<u4")
        data = tokenfile.encode_segment([5, None, -2], np.array([len(ids), 0, len(ids[:2])]), np.concatenate([ids, ids[:2]]))
        doc_ids, sizes, got = tokenfile.decode_segment(data)
        assert doc_ids == [5, None, -2] and sizes.tolist() == [len(ids), 0, len(ids[:2])]
        assert np.array_equal(got, np.concatenate([ids, ids[:2]]))
    for at in (-5, -200_000):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            tokenfile.decode_segment(bytes(broken))
    skewed = np.minimum(r.geometric(0.3, 300_000), 60).astype("<u4")
    assert len(tokenfile.encode_segment([1], np.array([len(skewed)]), skewed)) < 4 * len(skewed) / 10


def test_token_files(docs, by_id, none, spark, tmp_path):
    at, want = 0, []
    for d in sorted(by_id):
        ids = own_ids(BYTES, by_id[d], 0)
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    tokenfile.write(docs, str(tmp_path / "t"), BYTES, segment_tokens=3000)
    assert sorted(map(tuple, tokenfile.read(spark, str(tmp_path / "t")).collect())) == want
    assert sorted(map(tuple, tokenfile.round_trip(docs, BYTES).collect())) == want
    assert tokenfile.round_trip(none, BYTES).count() == 0


def test_token_files_of_null_and_repeated_ids(spark):
    rows = [(None, "no id"), (4, "four"), (4, "other four"), (4, "four"), (2, None), (None, ""), (-1, " below ")]
    got = tokenfile.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), BYTES).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d is not None, d or 0, len(own_ids(BYTES, t, 0)) // 4, zlib.crc32(own_ids(BYTES, t, 0))) for d, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, -1, 2, 4, 4, 4]


@pytest.mark.parametrize("sizes", [[], [1], [4096], [5000, 3, 700], [1] * 9, [4095, 4095, 2], None])
def test_packs_are_full(sizes):
    r = random.Random(6)
    sizes = sizes if sizes is not None else [r.choice([1, 7, 300, 600, 1500, 3000, 9000]) + r.randint(0, 90) for _ in range(500)]
    rows = pack.pack(sizes)
    seen = defaultdict(list)
    for row in rows:
        n = sum(p[2] for p in row)
        assert n <= 4096 and n & (n - 1) == 0 and all(p[2] > 0 for p in row)
        for d, s, k in row:
            seen[d].append((s, k))
    for d, n in enumerate(sizes):
        assert sum(k for _, k in seen[d]) == n
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at
            at += k
    tier, group = pack.step_groups(rows, pack.TIERS, 1 << 15)
    held = defaultdict(int)
    for t, g in zip(tier, group, strict=True):
        held[g, t] += t
    assert all(v <= 1 << 15 for v in held.values()) and len({g for g, _ in held}) == len(held)


def test_packing(docs, by_id, none):
    ids = {d: own_ids(WORDS, t, 2) for d, t in by_id.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack.packed(docs, WORDS, pool_tokens=5000).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) // 4 and r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [(pieces[d], len(i) // 4) for d, i in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == total if total else at <= 4096 and at & (at - 1) == 0
    assert pack.packed(none, WORDS).count() == 0


def test_media(docs, by_id, none):
    for r in media.media_index(docs).collect():
        raw = (by_id[r.doc_id] or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        n = len(padded) // 576
        assert (r.codec, r.samples, len(r.keyframes)) == ("raw ", n, -(-n // 12)) and abs(r.duration - n / 25) < 1e-9
        assert r.media_sha256 == hashlib.sha256(media.encode(padded)).hexdigest()
        assert all(k.end - k.start == 576 for k in r.keyframes)
    assert media.media_index(none).count() == 0


def fragmented(sizes, keys):
    """An MP4 of which all samples are in fragments: run by run, with sizes per sample or by default."""
    full, box = media.full, media.box
    stbl = box(b"stbl", media.STSD, *(full(k, bytes(4)) for k in (b"stts", b"stsc", b"stco")), full(b"stsz", bytes(8)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 50, 0, 0, 0)), media.HDLR, box(b"minf", stbl))
    trak = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 9, 0, 0), bytes(60)), mdia)
    out = media.FTYP + box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">5I", 9, 1, 2, 7, 0x10000))))
    want = []
    for own in sizes:
        def moof(at, own=own):
            rows = b"".join(struct.pack(">II", n, 0 if n in keys else 0x10000) for n in own)
            runs = full(b"trun", struct.pack(">Ii", len(own), at), rows, flags=0x601) + full(b"trun", struct.pack(">I", 2), flags=0)
            return box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 9), flags=0x20000), runs))
        head = moof(len(moof(0)) + 8)
        at = len(out) + len(head) + 8
        for n in own:
            want.append((at, at + n, n in keys))
            at += n
        want += [(at, at + 7, False), (at + 7, at + 14, False)]
        out += head + box(b"mdat", bytes(sum(own) + 14))
    return out, want


def test_fragments():
    data, want = fragmented([(5, 3, 11), (4, 5)], {5, 11})
    (track,) = media.tracks(data)
    assert track["ranges"] == [w[:2] for w in want] and track["keys"] == [w[:2] for w in want if w[2]]
    assert (track["codec"], track["scale"], track["duration"]) == ("raw ", 50, 2 * len(want))
    for cut in range(len(data)):
        media.tracks(data[:cut])


def test_containers_of_others():
    chunked = media.encode(bytes(576 * 5))
    assert media.tracks(b"") == media.tracks(b"no container at all") == []
    for cut in range(0, len(chunked), 37):
        media.tracks(chunked[:cut])
    r = random.Random(8)
    for _ in range(300):
        bad = bytearray(chunked[:900])
        for _ in range(5):
            bad[r.randrange(len(bad))] = r.randrange(256)
        media.tracks(bytes(bad))
    stbl = media.box(b"stbl", media.STSD, media.full(b"stsz", struct.pack(">IIIII", 0, 3, 5, 6, 7)), media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), media.full(b"co64", struct.pack(">IQQ", 2, 100, 500)))
    (track,) = media.tracks(media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl)))))
    assert track["ranges"] == [(100, 105), (105, 111), (500, 507)] == track["keys"]


PAGES = [(5, "http://a", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (9, None, None), (8, "http://c\r\nX: 1", ""), (7, "http://d", "é\r\n\r\nWARC/1.1\r\n\r\n"), (2, "http://e", "<p>x</p>"), (11, "http://f", "y" * 100_000)]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload_digest", F.lit("mine"))
    first = {}
    for p, _, h in sorted(PAGES):
        first.setdefault(h or "", p)
    for least in (0, 5):
        got = {r.page_id: r for r in warc.archived(pages, least).collect()}
        assert len(got) == len(PAGES)
        for p, _, h in PAGES:
            raw = (h or "").encode()
            again = first[h or ""] < p and len(raw) >= least
            r = got[p]
            assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (r.record_type, r.refers_to, r.payload_ok) == (("revisit", first[h or ""], True) if again else ("response", None, True))
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, per_file=2)
    assert len(glob.glob(f"{path}/part-*")) >= 4
    for f in glob.glob(f"{path}/part-*"):
        for head, block in warc.parse(gzip.open(f).read()):
            assert head["warc-type"] in ("response", "revisit") and bytes(block).startswith(b"HTTP/1.1 200 OK\r\n")
    assert warc.archived(pages.limit(0)).count() == 0


def test_archives_are_cut_by_bytes(spark, tmp_path):
    sizes = [10, 8191, 8192, 9000, 65_535, 65_536, 70_000, 1 << 20, (1 << 20) + 5, 3 << 20] * 2
    rows = [(i, f"http://p/{i}", chr(97 + i) * n) for i, n in enumerate(sizes)] + [(100, "http://again", "a" * 10), (101, "http://again", "c" * 8192)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, file_bytes=1 << 18)
    held = [[len(block) for _, block in warc.parse(gzip.open(f).read())] for f in glob.glob(f"{path}/part-*")]
    assert sum(map(len, held)) == len(rows) and all(len(x) == 1 or sum(x) <= (1 << 18) + 200 * len(x) for x in held)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert all(got[i].payload_ok and (got[i].payload_bytes, got[i].payload_digest) == (len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for i, _, h in rows)
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {100, 101}


def test_archives_of_nameless_and_repeated_pages(spark):
    rows = [(None, "http://n", "<p>n</p>"), (None, "http://m", "<p>x</p>"), (None, None, None), (1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (2, "http://b", "other"), (2, "http://c", "third"), (3, "http://d", "other")]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    sha1 = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    refers = {(2, "<p>x</p>"): 1, (3, "other"): 2}
    want = [(p, u or "", len(h or ""), sha1(h), "revisit" if (p, h) in refers else "response", refers.get((p, h)), True) for p, u, h in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def labelled(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = r.random() < 0.7
        words = ["".join(r.choice(["ka", "lo", "mi", "ter"]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(w + ("" if good or r.random() < 0.6 else "###") for w in words), int(good)))
    return rows


def test_quality(spark, none):
    rows = labelled(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "z" * 50_000)], "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(0, None), (2, 9), (1, rows[1][2])], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[1000].score == got[1001].score
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    right = [got[i].predicted == y for i, _, y in rows if i % 2 == 0 or got[i].held_out]
    assert sum(right) / len(right) > 0.95
    again = {r.doc_id: r.score for r in quality.report(docs.repartition(5), labels).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    kept = quality.keep(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality.report(none.select("doc_id", "text"), labels).count() == 0
    assert {round(r.score, 6) for r in quality.report(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_not_used(spark):
    rows = labelled(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: r.score for r in quality.report(docs, x).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    ids = [{r.doc_id for r in docs.collect()}]
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        assert (docs.columns == columns) == (name != "packing")
        ids.append({r.doc_id for r in docs.collect()})
        assert ids[-1] <= ids[-2]
    assert len(ids[1]) < len(ids[0]) and len(ids[2]) < len(ids[1]) and ids[4] == ids[3] == ids[5]
    whole = sorted(map(tuple, P.run(spark, SMALL).select("doc_id", "start", "length", "ids_crc32").collect()))
    starts = {d for d, s, _, _ in whole if s == 0}
    assert starts == ids[5]


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, blank and long texts, columns that operators might use themselves, and an empty table."""
    import corpus_pipeline as P

    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    leak = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, leak.upper() + " eleven"), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = lambda i: f"the {i} garden of {i * 7} green trees stands by river {i * 13} and lake {i * 17} near town {i * 3} where {i * 5} people walk"
    rows = [(i, good(i) if i % 2 else f"zz{i}!! qq## " * 9) for i in range(60)]
    rows += [(None, good(1000)), (None, good(1000)), (None, None), (71, None), (72, " "), (73, ""), (75, good(75) + " bob@corp.example"), (75, good(76)), (77, good(78)), (None, leak + " " + good(90)), (78, (good(91) + " ") * 400)]
    df = spark.createDataFrame([(d, t, "x", 1.5, "k") for d, t in rows], "doc_id long, text string, node string, score double, bucket string").repartition(3)
    docs, sizes = df, []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == df.columns
            docs = docs.cache()
            sizes.append(docs.count())
    texts = [r.text for r in P.STAGES[3][1](spark, P.STAGES[2][1](spark, df, str(tmp_path)), str(tmp_path)).collect()]
    assert len(texts) == len(rows) - 1 and sum(t is None for t in texts) == 2 and any(t and "[EMAIL]" in t for t in texts) and not any(t and "bob@" in t for t in texts)
    near = P.STAGES[1][1](spark, df, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in near) == 4  # rows without an id can't be told apart by it
    assert {r.doc_id for r in near} >= {i for i in range(60) if i % 2} | {75, 77, 78}
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 20
    pieces = docs.collect()
    assert sum(r.doc_tokens for r in pieces if r.start == 0) == sum(r.length for r in pieces)
    for name, stage in P.STAGES:
        empty = stage(spark, df.limit(0), str(tmp_path))
        assert empty.count() == 0 and (name == "packing" or empty.columns == df.columns)


def test_dual_descent_against_projected_gradient():
    r = np.random.default_rng(3)
    labels = r.integers(0, 2, 40)
    rows = [np.unique(np.concatenate([r.integers(0, 30, 6), r.integers(30, 40, 3) + 10 * y])) for y in labels]
    ratio, w, bias = quality.descend(rows, labels, 1.0, 3000, 1.0, 5)
    counts = np.ones((2, 1 << quality.BITS))
    for b, y in zip(rows, labels, strict=True):
        counts[y, b] += 1
    want = np.log(counts[1] / (labels.sum() + 2)) - np.log(counts[0] / ((1 - labels).sum() + 2))
    assert np.allclose(ratio, want)
    x = np.zeros((40, 60))
    for i, b in enumerate(rows):
        x[i, b] = want[b] / np.linalg.norm(want[b])
    x = np.hstack([x[:, :50], np.ones((40, 1))])  # the bias is a feature of its own
    y = 2 * labels - 1
    most = 40 / (2 * np.bincount(labels, minlength=2))[labels]
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, most)
    best = (x * y[:, None]).T @ alpha
    primal = lambda v: 0.5 * v @ v + (most * np.maximum(0, 1 - y * (x @ v))).sum()
    got = np.append(w[:50], bias)
    assert abs(primal(got) - primal(best)) < 1e-3 * primal(best) and np.abs(got - best).max() < 0.02


def test_rows_that_repeat_an_id_are_one_of_the_sample(spark):
    rows = labelled(60, 4)
    docs = spark.createDataFrame([(i, f"{t} {k}") for i, t, _ in rows for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    seen = []
    fit_rows, quality.fit_rows = quality.fit_rows, lambda buckets, ys: seen.append(len(buckets)) or fit_rows(buckets, ys)
    try:
        scores = [quality.report(d, labels).where("doc_id is not null").toPandas().score.sort_values().tolist() for d in (docs, docs.repartition(7))]
    finally:
        quality.fit_rows = fit_rows
    assert seen[0] == seen[1] <= 60 and np.allclose(*scores)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_decontamination", "op3_substrings", "op5_secrets", "op10_warc"])
def test_sql_twins(spark, name):
    import duckdb

    from lacquer.llm import queries

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = queries.queries()[name](spark, SMALL)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)
