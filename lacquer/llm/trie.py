"""Prefix trie of conversations: balanced parentheses per shard, whose shared spines are merged.

A node is a distinct sequence of first turns, known by its depth and two XORs
of hashes of its turns and their places. Nodes over more turns than a bound make
the spine that shards share; what hangs below it falls into subtrees of at most
that many nodes, and a shard is a forest of such subtrees in one task. A shard is
written as a sequence of parentheses in depth-first order; findclose, over a
tree of the least and greatest excess of its blocks, gives the end of a
subtree, a count of leaf pairs "()" its leaves, and running sums its savings.
The spine is contracted to its branches and summed in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scan import scanned
from .common import drop, give_back, ship, stored

BLOCK = 64


class Parentheses:
    """A balanced sequence (1 opens) with leaf ranks and findclose over a tree of range minima of the excess."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        n = -(-len(bits) // BLOCK)
        size = 1 << max(0, (n - 1).bit_length())
        spare = size * BLOCK - len(bits)
        bounds = np.iinfo(np.int32)
        self.lowest = [np.append(self.excess, np.full(spare, bounds.max, np.int32)).reshape(-1, BLOCK).min(1)]
        self.highest = [np.append(self.excess, np.full(spare, bounds.min, np.int32)).reshape(-1, BLOCK).max(1)]
        while len(self.lowest[-1]) > 1:
            self.lowest.append(self.lowest[-1].reshape(-1, 2).min(1))
            self.highest.append(self.highest[-1].reshape(-1, 2).max(1))
        leaf = np.zeros(len(bits) + 1, np.int64)
        leaf[1:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.leaf_rank = np.cumsum(leaf)

    def leaves(self, opened: np.ndarray, closed: np.ndarray) -> np.ndarray:
        """Leaf pairs from each opening to its closing parenthesis: a pair counts at its second half."""
        return self.leaf_rank[closed] - self.leaf_rank[opened]

    def findclose(self, opened: np.ndarray) -> np.ndarray:
        """Of each opening position that of its closing one: the first to the right whose excess is below that at the opening."""
        target = self.excess[opened] - 1
        at = self._in_block(opened + 1, target)
        left = np.flatnonzero(at < 0)
        block, level = opened[left] // BLOCK, np.zeros(len(left), np.int64)
        found = np.zeros(len(left), bool)
        for k, lowest in enumerate(self.lowest):  # up, until a right sibling goes low enough
            on = np.flatnonzero(~found)
            if not len(on):
                break
            sibling = block[on] + 1
            hit = (block[on] % 2 == 0) & (sibling < len(lowest))
            hit[hit] = (lowest[sibling[hit]] <= target[left[on[hit]]]) & (self.highest[k][sibling[hit]] >= target[left[on[hit]]])
            block[on[hit]] += 1
            level[on[hit]], found[on[hit]] = k, True
            block[on[~hit]] //= 2
        for k in range(len(self.lowest) - 1, 0, -1):  # down, to the first block that does
            on = np.flatnonzero(level == k)
            first = 2 * block[on]
            block[on] = np.where(self.lowest[k - 1][first] <= target[left[on]], first, first + 1)
            level[on] = k - 1
        at[left] = self._in_block(block * BLOCK, target[left])
        return at

    def _in_block(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first place with this excess from start to the end of its block, or -1."""
        out, ends = np.full(len(start), -1), np.minimum((start // BLOCK + 1) * BLOCK, len(self.bits))
        on = np.arange(len(start))
        for step in range(BLOCK):
            on = on[(out[on] < 0) & (start[on] + step < ends[on])]
            if not len(on):
                break
            hit = self.excess[start[on] + step] == target[on]
            out[on[hit]] = start[on[hit]] + step
        return out


def encoded(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parentheses of a forest given by each node's parent (-1: a root), and the nodes in depth-first order."""
    n = len(parent)
    by = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[by], np.arange(n + 1)).tolist()
    roots = by[: first[0]].tolist() if n else []
    kids = by.tolist()
    bits, order, stack = bytearray(), [], roots[::-1]
    while stack:
        v = stack.pop()
        if v < 0:
            bits.append(0)
            continue
        bits.append(1)
        order.append(v)
        stack.append(-1)
        stack.extend(reversed(kids[first[v] : first[v + 1]]))
    return np.frombuffer(bytes(bits), np.uint8), np.array(order, np.int64)


def subtree_sums(parent: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node of a forest its leaves and, column by column, the sums of weights over its subtree."""
    bits, order = encoded(parent)
    tree = Parentheses(bits)
    opened = np.flatnonzero(bits)
    closed = tree.findclose(opened)
    size = (closed - opened + 1) // 2
    running = np.vstack([np.zeros((1, weights.shape[1]), np.int64), np.cumsum(weights[order], axis=0)])
    at = np.arange(len(order))
    leaves, sums = np.zeros(len(parent), np.int64), np.zeros_like(weights)
    leaves[order] = tree.leaves(opened, closed)
    sums[order] = running[at + size] - running[at]
    return leaves, sums


def pages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a 16-byte digest of role and text, and the text's words; null roles and texts are empty."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    return own.where("conv_id is not null").select("conv_id", "turn", digest.alias("content"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, d, content, words, len) of the rebuilt conversations, and the conversations (conv_id, len), turnless ones too.

    Depths of own turns follow from ranks by scans, not from windows: a
    conversation with a third of all turns is ranked in many tasks.
    """
    ranked = scanned(turns.withColumn("one", F.lit(1).cast("long")), ["conv_id"], ["turn", "content"], {"one": "sum"}).withColumnRenamed("one_run", "rank")
    sizes = ranked.groupBy("conv_id").agg(F.max("rank").alias("n"))
    # at most the first three turns of every twentieth conversation
    first = ranked.where(f"rank <= 3 and conv_id % {group} = 0").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content", "words"))).alias("first"))
    convs = sizes.select("*", head_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    convs = convs.join(first.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("shared", F.slice(F.coalesce("first", F.array().cast("array<struct<rank:bigint,content:binary,words:bigint>>")), F.lit(1), F.col("h").cast("int")))
    convs = stored(convs.select("conv_id", "h", "shared", (F.size("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("len")), "conversations")
    begun = convs.select("conv_id", "len", F.posexplode("shared").alias("at", "t")).select("conv_id", (F.col("at") + 1).cast("long").alias("d"), "t.content", "t.words", "len")
    own = ranked.join(convs.select("conv_id", "h", F.size("shared").alias("begun"), "len"), "conv_id").where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("begun")).alias("d"), "content", "words", "len")
    return begun.unionByName(own), convs.select("conv_id", "len")


KEY = ["d", "x", "y"]


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows (conv_id, d, x, y, v, w, words, len): each conversation's prefixes, from the root on; x and y name one, x ^ v and y ^ w its parent."""
    hashed = turns.select("conv_id", "d", F.xxhash64("d", "content").alias("v"), F.xxhash64("content", "d").alias("w"), "words", "len")
    run = scanned(hashed, ["conv_id"], ["d"], {"v": "xor", "w": "xor"}).withColumnsRenamed({"v_run": "x", "w_run": "y"})
    zero = [F.lit(0).cast("long").alias(c) for c in ("d", "x", "y", "v", "w", "words")]
    return run.unionByName(convs.select("conv_id", *zero, "len"))


def end_digests(rows: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """Of each node that is a whole conversation the SHA-256 of its conv_ids, ascending and comma-joined.

    Sorted ranges join their ids to pieces of about 64 KB, so that a node with a
    third of all conversations reaches its task as few rows, which are hashed as
    they come.
    """
    names = [*KEY, "first", "ids"]

    def runs(keys: np.ndarray) -> list[tuple[int, int]]:
        head = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]).tolist()
        return list(zip(head, [*head[1:], keys.shape[1]], strict=True))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.vstack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            out = [(*t[:3, a].tolist(), int(t[3, lo]), ",".join(map(str, t[3, lo : min(b, lo + piece // 8)].tolist()))) for a, b in runs(t[:3]) for lo in range(a, b, piece // 8)] if batch.num_rows else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if key != last:
                    if digest:
                        out.append((*last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*last, digest.hexdigest())], [*KEY, "ends_sha256"])

    key = "d long, x long, y long"
    ranged = rows.where("d = len").select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    pieces = ranged.mapInArrow(joined, f"{key}, first long, ids string").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return pieces.mapInArrow(hashed, f"{key}, ends_sha256 string")


COUNTED = "d long, x long, y long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long, v long, w long"


def in_shards(light: DataFrame, chunk: int = 200_000) -> DataFrame:
    """Subtree counts of all nodes below the spine: shards of whole subtrees (unit), each written as parentheses. parent_conv_id is null at their roots."""
    fields = [*KEY, "v", "w", "conv_id", "n_convs", "words"]

    def counted(t: np.ndarray) -> pa.RecordBatch:
        d, x, y, v, w, conv, n, words = t
        size = t.shape[1]
        keys = np.vstack([np.r_[d, d - 1], np.r_[x, x ^ v], np.r_[y, y ^ w], np.r_[np.zeros(size, np.int64), np.ones(size, np.int64)]])
        by = np.lexsort(keys[::-1])
        head = np.r_[True, (keys[:3, by[1:]] != keys[:3, by[:-1]]).any(0)]
        group = np.empty(2 * size, np.int64)
        group[by] = np.cumsum(head) - 1
        owner = np.full(int(head.sum()), -1)
        owner[group[:size]] = np.arange(size)
        parent = owner[group[size:]]
        leaves, saved = subtree_sums(parent, ((n - 1) * words)[:, None])
        kids = np.bincount(parent[parent >= 0], minlength=size)
        above = pa.array(conv[np.maximum(parent, 0)], mask=parent < 0)
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in (d, x, y, conv, n, above, kids, leaves, saved[:, 0], v, w)], [f.split()[0] for f in COUNTED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.vstack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(11)]))
            if sum(t.shape[1] for t in held) >= chunk:
                t = np.hstack(held)
                cut = np.flatnonzero((t[:3, 1:] != t[:3, :-1]).any(0))
                held = [t]
                if len(cut):
                    yield counted(t[3:, : cut[-1] + 1])
                    held = [t[:, cut[-1] + 1 :]]
        if held:
            yield counted(np.hstack(held)[3:])
        give_back()

    unit = ["ud", "ux", "uy"]
    return light.select(*unit, *fields).repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, COUNTED)


def merged_spine(spine: DataFrame, hung: DataFrame) -> DataFrame:
    """Counts of the spine's nodes: their own, those of the subtrees that hang from them, and those of the spine below.

    Runs of nodes without a branch are summed by a scan. What is left, a branch
    per node, has at most two nodes for every `most` turns of the input, and is
    one shard.
    """
    ship(spine.sparkSession)
    up = lambda df: df.select(*df.columns, (F.col("d") - 1).alias("pd"), F.col("x").bitwiseXOR(F.col("v")).alias("px"), F.col("y").bitwiseXOR(F.col("w")).alias("py"))
    above = ["pd", "px", "py"]
    renamed = lambda df, to: df.withColumnsRenamed(dict(zip(KEY, to, strict=True)))
    below = up(hung.where("parent_conv_id is null and d > 0")).groupBy(*above).agg(F.count("*").alias("units"), F.sum("n_leaves").alias("unit_leaves"), F.sum("saved_tokens").alias("unit_saved")).withColumnsRenamed(dict(zip(above, KEY, strict=True)))
    own = up(spine)
    kids = own.where("d > 0").groupBy(*above).agg(F.count("*").alias("kids")).withColumnsRenamed(dict(zip(above, KEY, strict=True)))
    nodes = own.join(kids, KEY, "left").join(below, KEY, "left").na.fill(0, ["kids", "units", "unit_leaves", "unit_saved"])
    nodes = nodes.withColumn("leaves", F.col("unit_leaves") + F.when(F.col("kids") + F.col("units") == 0, 1).otherwise(0)).withColumn("saved", F.col("unit_saved") + (F.col("n_convs") - 1) * F.col("words"))
    parents = renamed(nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"), F.col("kids").alias("siblings")), above)
    nodes = nodes.join(parents, above, "left").withColumn("top", F.when((F.col("d") == 0) | (F.col("siblings") > 1) | (F.col("parent_conv_id") != F.col("conv_id")), 1).otherwise(0).cast("long"))
    nodes = scanned(nodes, ["conv_id"], ["d"], {"top": "sum", "leaves": "sum", "saved": "sum"}).withColumnRenamed("top_run", "run")
    runs = nodes.groupBy("conv_id", "run").agg(F.min_by(F.struct(*above), "d").alias("from"), F.sum("leaves").alias("own_leaves"), F.sum("saved").alias("own_saved"), F.max("leaves_run").alias("last_leaves"), F.max("saved_run").alias("last_saved"))
    ends = renamed(nodes.select(*KEY, F.struct("conv_id", "run").alias("parent")), above)
    runs = runs.select("conv_id", "run", "from.*", "own_leaves", "own_saved", "last_leaves", "last_saved").join(ends, above, "left")

    def branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ids = list(zip(t.column("conv_id").to_pylist(), t.column("run").to_pylist(), strict=True))
        at = {key: i for i, key in enumerate(ids)}
        parent = np.array([-1 if p is None else at[(p["conv_id"], p["run"])] for p in t.column("parent").to_pylist()], np.int64)
        weights = np.column_stack([t.column(c).to_numpy() for c in ("own_leaves", "own_saved")])
        _, sums = subtree_sums(parent, weights)
        # what lies below the last node of each run, and the run's own running totals at its end
        rest = sums - weights
        yield pa.RecordBatch.from_arrays([t.column("conv_id").chunk(0), t.column("run").chunk(0), *(pa.array(rest[:, k] + t.column(c).to_numpy()) for k, c in ((0, "last_leaves"), (1, "last_saved")))], ["conv_id", "run", "to_leaves", "to_saved"])

    found = runs.select("conv_id", "run", "parent", "own_leaves", "own_saved", "last_leaves", "last_saved").coalesce(1).mapInArrow(branches, "conv_id long, run long, to_leaves long, to_saved long")
    out = nodes.join(found, ["conv_id", "run"])
    return out.select(
        *KEY, "conv_id", "n_convs", "parent_conv_id", (F.col("kids") + F.col("units")).alias("n_children"),
        (F.col("to_leaves") - F.col("leaves_run") + F.col("leaves")).alias("n_leaves"), (F.col("to_saved") - F.col("saved_run") + F.col("saved")).alias("saved_tokens"), "v", "w",
    )


EMPTY = hashlib.sha256(b"").hexdigest()


def nodes(conversations: DataFrame, most: int | None = None, least: int = 500, branches: int = 50_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the trie of the rebuilt conversations.

    Turns are in the order of turn, nulls first, and those of one turn in that of
    the MD5 of "<bytes of role>:<role><text>"; repeated rows are turns of their
    own. Null roles and texts are empty; rows with a null conv_id belong to no
    conversation. conv_id % 20 keeps the sign, as in SQL. No conversations, no
    root. Prefixes are equal if 128 bits of hashes of their turns are.

    A subtree below the spine has at most `most` nodes; by default 500, or the
    turns by 50,000, so that the contracted spine, which is one task, never has
    over 100,000 nodes, and the share of a subtree in the whole stays small.
    """
    spark = conversations.sparkSession
    ship(spark)
    turns, convs = rebuilt(pages(conversations))
    rows = prefixes(turns, convs)
    if most is None:
        most = max(least, (convs.agg(F.sum(F.col("len") + 1)).first()[0] or 0) // branches)
    every = stored(rows.withColumn("size", F.col("len") - F.col("d") + 1).groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.max(c).alias(c) for c in ("v", "w", "words")), F.sum("size").alias("size")), "nodes")
    spine, light = every.where(F.col("size") > most).drop("size"), every.where(F.col("size") <= most)
    above = spine.select((F.col("d") + 1).alias("d"), F.col("x").alias("px"), F.col("y").alias("py"))
    own = light.withColumns({"px": F.col("x").bitwiseXOR(F.col("v")), "py": F.col("y").bitwiseXOR(F.col("w"))})
    units = stored(own.where("d > 0").join(above, ["d", "px", "py"], "left_semi").select(*KEY).unionByName(light.where("d = 0").select(*KEY)), "units")
    of = rows.join(units, KEY).select("conv_id", F.col("d").alias("ud"), F.col("x").alias("ux"), F.col("y").alias("uy"))
    hung = stored(in_shards(light.join(of, "conv_id")), "shards")
    spread = stored(merged_spine(spine, hung), "spine")
    roots = hung.where("parent_conv_id is null").drop("parent_conv_id").withColumns({"pd": F.col("d") - 1, "px": F.col("x").bitwiseXOR(F.col("v")), "py": F.col("y").bitwiseXOR(F.col("w"))})
    named = roots.join(spread.select(F.col("d").alias("pd"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id")), ["pd", "px", "py"], "left")
    out = hung.where("parent_conv_id is not null").unionByName(named.select(*hung.columns)).unionByName(spread.select(*hung.columns))
    drop(spark, units)
    return out.join(end_digests(rows), KEY, "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )
