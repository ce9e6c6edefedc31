"""Connected components of an edge table by hooking and contraction, without collecting anything."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .common import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (u, v) reaches.

    Each round every node adopts the smallest of itself and its neighbours, these
    choices are followed to their ends by doubling, and edges move to the ends,
    until none joins two. Of the nodes with edges at most half are left after two
    rounds: one that is still smallest has a neighbour that went to it and to no
    other. So a path of n nodes takes about log2(n) joins, in whatever order its
    numbers are. Minima are combined before the shuffle, and a node of very many
    edges is split by the skew join.
    """
    spark = edges.sparkSession
    links = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "links")
    labels = stored(links.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = stored(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("at"), F.least("u", "least").alias("to"), F.lit(True).alias("moved")), "hook")
        while not hook.where("moved").isEmpty():
            on = hook.select(F.col("at").alias("to"), F.col("to").alias("next"))
            further = stored(hook.join(on, "to").select("at", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved")), "hook")
            drop(spark, hook)
            hook = further
        hook = hook.drop("moved")
        moved = links.join(hook, links.u == hook["at"]).select(F.col("to").alias("u"), "v").join(hook, F.col("v") == hook["at"]).select("u", F.col("to").alias("v"))
        next_links = stored(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "links")
        next_labels = stored(labels.join(hook, labels.component == hook["at"], "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        for old in (links, labels, hook):
            drop(spark, old)
        links, labels = next_links, next_labels
    return labels


def linked(rows: DataFrame, key: list[str], link: Callable[[DataFrame], DataFrame], most: int, largest: int) -> DataFrame:
    """Edges (u, v) whose closure is that of all links within the groups of rows (key, n, id and more), where n is a group's size and largest that of the largest.

    `link` gives edges of each cell (key, cell) whose closure is that of the
    cell's links. A group of up to `most` is a cell. A larger one is dealt out in
    blocks of about that size, and first each block meets block 0. What is in the
    group's largest component then need not meet again: only the rest meets all
    others, block by block. So a group of many copies costs about as much as its
    size, and every pair of two components is compared.
    """
    spark = rows.sparkSession
    own = rows.withColumn("cell", F.lit(0))
    if largest <= most:
        return link(own.drop("n"))
    large = rows.where(F.col("n") > most)
    blocks = F.ceil(F.col("n") / most).cast("int")
    block = F.pmod(F.xxhash64("id", *key), blocks).cast("int")
    first = large.withColumn("cell", F.explode(F.when(block == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block))))
    edges = stored(link(own.where(F.col("n") <= most).unionByName(first).drop("n")), "edges")
    found = stored(components(edges), "components")
    at = large.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = at.groupBy(*key, "component").agg(F.count("*").alias("size"))
    main = sizes.groupBy(*key).agg(F.max_by("component", F.struct("size", "component")).alias("main"), (F.sum("size") - F.max("size")).alias("others")).where("others > 0")
    state = stored(at.join(main, key).withColumn("rest", F.col("component") != F.col("main")).drop("component", "main"), "groups")
    if state.isEmpty():
        return edges
    parts, chunks = F.ceil(F.col("others") / most).cast("int"), F.ceil(F.col("n") / most).cast("int")
    part, chunk = F.pmod(F.xxhash64("id", *key, F.lit(1)), parts).cast("int"), F.pmod(F.xxhash64("id", *key), chunks).cast("int")
    # cells of two parts of the rest, then of a part and a chunk of the main component
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.least(x, part) * parts + F.greatest(x, part))
    beside = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: parts * parts + part * chunks + c)
    across = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: parts * parts + x * chunks + chunk)
    again = state.withColumn("cell", F.explode(F.when(F.col("rest"), F.concat(pairs, beside)).otherwise(across))).select(*own.drop("n").columns)
    more = stored(link(again), "edges")
    for table in (found, state):
        drop(spark, table)
    return edges.unionByName(more)
