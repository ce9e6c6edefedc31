"""Centroids, quality rules and the conversation trie against plain Python, and their odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lacquer.llm import centroids, rules, trie
from lacquer.operators.scan import scanned


def lloyd(rows, k, rounds, seed, dim):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) <= 131072 for x in v)]
    by = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])) + sorted((r for r in kept if r[0] is None), key=lambda r: r[1])
    means = [v for _, v in by[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = [[v for _, v in kept if near(v)[1] == c] for c in range(len(means))]
        means = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else m for g, m in zip(groups, means, strict=True)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    return sorted(((i, c, d, sum(e for _, o, e in out if o == c), sum(e for *_, e in out), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, c, d in out), key=str)


@pytest.mark.parametrize("k", [1, 3, 8, 200])
def test_centroids_equal_plain_rounds(spark, k):
    r = random.Random(k)
    heads = [[r.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(heads)]) for i in range(60)] + [(7, [0.5] * 6)] * 9
    rows += [(None, [1.0] * 6), (None, [2.0] * 6), (70, None), (71, []), (72, [1.0] * 5), (73, [1.0, None] * 3), (74, [math.nan] * 6), (75, [math.inf] * 6), (76, [1e9] * 6), (77, [-131072.0] * 6), (78, [131072.0] * 6), (-5, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(5)
    found, means = centroids.cluster(df, k=k, rounds=5, seed=3, dim=6, lead=2)
    assert sorted(map(tuple, found.collect()), key=str) == lloyd(rows, k, 5, 3, 6)
    assert len(means) == min(k, 74)


def test_centroids_of_nothing(spark):
    found, means = centroids.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), dim=6)
    assert found.collect() == [] and means == [] and found.columns[0] == "vec_id"


def test_the_filter_rules_distances_out(spark):
    r = np.random.default_rng(1)
    axes = np.linalg.qr(r.normal(size=(64, 64)))[0]
    spread = np.where(np.arange(64) < 8, 3000, 30)
    heads = r.normal(size=(8, 64)) * spread @ axes.T
    x = np.floor(heads[r.integers(0, 8, 2000)] + r.normal(size=(2000, 64)) * spread / 10 @ axes.T).astype(np.int64)
    lead = np.ascontiguousarray(axes[:, :8])
    means = np.floor(heads).astype(np.int64)
    chosen, distance, taken = centroids.nearest(x, np.column_stack(centroids.rotated(x, lead)), means, lead)
    every = ((x[:, None] - means) ** 2).sum(2)
    assert (chosen == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert taken < 1.2 * len(x)  # of 8 * len(x)


def plain_rules(rows, labels, threshold):
    def grams(text):
        prime, out = 2**31 - 1, []
        places = [pow(16807, i + 1, prime) for i in range(64)]
        ws = [sum(ord(c) * places[i % 64] % prime for i, c in enumerate(re.sub("[A-Z]", lambda m: m[0].lower(), w))) % prime for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        return [w * 40692 % prime % 65536 for w in ws] + [(a * 69621 + b * 48271) % prime % 65536 for a, b in zip(ws, ws[1:], strict=False)]

    said = {}
    for i, q, t in labels:
        said.setdefault(i, []).append((q, t))
    good = {i for i, x in said.items() if i is not None and (q := [a for a, _ in x if a is not None]) and min(q) == 1 and max(b or 0 for _, b in x) == 0}
    raw, target = {}, {}
    for i, text, *_ in rows:
        for b in grams(text or ""):
            raw[b] = raw.get(b, 0) + 1
            if i in good:
                target[b] = target.get(b, 0) + 1
    share = sum(target.values()) / max(1, sum(raw.values()))
    out = []
    for i, text, *_ in rows:
        text = text or ""
        ws, gs = re.findall(r"[^\x20\x09-\x0D]+", text), grams(text)
        score = sum(math.floor(math.log((target.get(b, 0) + 8) / (raw[b] * share + 8)) * 65536 + 0.5) for b in gs)
        windows = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
        out.append((i, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed, len(gs), score, not failed and score >= math.floor(threshold * 65536 + 0.5) * len(gs)))
    return sorted(out, key=str)


def test_rules_equal_plain_counts(spark, docs, by_id):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 5000]
    rows += [(None, "a b c " * 30), (3, "same line\nsame line\n\n \nsame line"), (3, "x" * 70 + " " + "x" * 134), (900, "#a <b> $%&|*\n" * 60), (901, "one two three " * 40), (902, "\n\n"), (903, "Ünï ÇÄP ÿÿ \U0001f600\U0001f600 á")]
    labels = [(i, int(i % 3 > 0), None if i % 5 else 0) for i in range(40)] + [(1, 0, 0), (4, 1, 1), (None, 1, 0), (7, None, None), (8, 1, 0), (8, 1, 0), (99999, 1, 0)]
    table = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, score int, bucket string").repartition(3)
    said = spark.createDataFrame([(*x, "q") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = rules.judged(table, rules.fit(table, said), -0.01)
    assert sorted(map(tuple, got.collect()), key=str) == plain_rules(rows, labels, -0.01)
    assert 0 < got.where("kept").count() < got.where("not base_failed").count()


def test_rules_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.judged(none, rules.fit(none, labels)).collect() == []
    one = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.score for r in rules.judged(one, rules.fit(one, labels)).orderBy("doc_id").collect()] == [rules.log_ratios(np.zeros(1), np.array([1]))[0] * 3, 0]


def plain_trie(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    full = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: (h := zlib.crc32(str(c).encode()) % 4)] + own[c][h:]) for c in own}
    members, kids, saved, leaves = {}, {}, {}, {}
    for c, p in full.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
    ends = {p: ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))) for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()), key=str)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(3)
    rows = [(r.choice([None, *range(-30, 60)]), r.choice([None, 0, 1, 2, 3]), r.choice(["u", "a", None]), r.choice(["x", "x y", "", None, "z"])) for _ in range(300)]
    rows += [(100, i, "u", f"t{i % 7} w") for i in range(300)] + [(120 + k, i, "u", f"t{i % 7} w") for k in range(30) for i in range(40)]
    return rows + [(200 + k, i, "a", f"hot {i}" if i < 5 else f"own {k}") for k in range(40) for i in range(7)] + [(400, 0, "u", "word " * 20_000)]


@pytest.mark.parametrize("most", [20_000, 300, 30, 3])
def test_trie_equals_plain_prefixes(spark, talks, most):
    df = spark.createDataFrame([(*t, 1) for t in talks], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    assert sorted(map(tuple, trie.nodes(df, most).collect()), key=str) == plain_trie(talks)


def test_trie_of_nothing_and_of_a_turnless_conversation(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert trie.nodes(spark.createDataFrame([], kind)).collect() == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(c, 0, "u", "a")]
    assert sorted(map(tuple, trie.nodes(spark.createDataFrame(rows, kind)).collect()), key=str) == plain_trie(rows)


def test_parentheses_equal_a_stack():
    r = random.Random(5)
    for n in (1, 2, 63, 64, 65, 700, 9000):
        parent = np.array([-1 if i == 0 or r.random() < 0.01 else (i - 1 if r.random() < 0.6 else r.randrange(i)) for i in range(n)])
        bits, order = trie.encoded(parent)
        want, stack = {}, []
        for i, b in enumerate(bits.tolist()):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opened = np.flatnonzero(bits)
        tree = trie.Parentheses(bits)
        closed = tree.findclose(opened)
        assert closed.tolist() == [want[i] for i in opened.tolist()] and sorted(order.tolist()) == list(range(n))
        text = "".join("(" if b else ")" for b in bits)
        assert tree.leaves(opened, closed).tolist() == [text[a : b + 1].count("()") for a, b in zip(opened.tolist(), closed.tolist(), strict=True)]


def test_ids_of_a_node_are_joined_across_pieces(spark):
    rows = [(i, 1, 2, 3, 1) for i in range(-500, 3000)] + [(7, 0, 0, 0, 0), (8, 1, 5, 5, 2)]
    df = spark.createDataFrame(rows, "conv_id long, d long, x long, y long, len long").repartition(7)
    got = {tuple(r)[:3]: r.ends_sha256 for r in trie.end_digests(df, piece=64).collect()}
    assert got == {(1, 2, 3): hashlib.sha256(",".join(map(str, range(-500, 3000))).encode()).hexdigest(), (0, 0, 0): hashlib.sha256(b"7").hexdigest()}


def test_scans_of_few_long_keys(spark):
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None, "b"]), i, r.randrange(-5, 9), r.choice([None, 3, 8])) for i in range(2000)]
    got = scanned(spark.createDataFrame(rows, "k string, at int, n long, m long").repartition(6), ["k"], ["at"], {"n": "sum", "m": "xor"}).collect()
    n, m = {}, {}
    want = {}
    for k, at, a, b in rows:
        n[k], m[k] = n.get(k, 0) + a, m.get(k, 0) ^ (b or 0)
        want[at] = (n[k], m[k])
    assert {x["at"]: (x.n_run, x.m_run) for x in got} == want
