"""Budgets, composed texts and summaries over several micro-batches against batches."""

import random

import pytest
from pyspark.sql import functions as F

from lacquer.functions import policy as P
from lacquer.operators import fields, groups
from lacquer.operators.results import merge_partials, merge_summaries, partial_summaries
from lacquer.streaming import keep_partial_summaries, stream_batch_items, stream_compose, write_stream

KIND = "b string, i long, op string, name string, value string, at int"


def source(spark, tmp_path, rows):
    """A stream of one file, and so one micro-batch, for each `at`."""
    src = str(tmp_path / "src")
    for at in sorted({r[-1] for r in rows}):
        spark.createDataFrame([r for r in rows if r[-1] == at], KIND).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(src)


def items(seed):
    """Batches over four micro-batches, with items of lower index in later ones, and a key with most rows of one."""
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "c"]), i, *r.choice([("field", "note", "abcd"), ("field", "password", "x"), ("json", "n", '{"token":"abc","n":1}'), ("literal", "n", ""), ("http_url", "n", "https://h.example/p?token=t")]), r.randrange(4)) for i in range(60)]
    return rows + [("hot", i, "field", "note", "xy", 0) for i in range(400)] + [("hot", -1, "field", "note", "late", 2), ("a", None, "literal", "n", "first", 3)]


@pytest.mark.parametrize("most", [10, 60, 16_384])
def test_streams_equal_batches_in_order_of_arrival(spark, tmp_path, most):
    policy = P.Policy(limits=P.Limits(max_output_bytes=most))
    rows = items(most)
    # what a batch makes of the items if they are numbered as they came
    order = sorted(rows, key=lambda x: (x[-1], x[1] is not None, x[1] or 0))
    numbered = spark.createDataFrame([(b, n, op, name, value, at) for n, (b, _, op, name, value, at) in enumerate(order)], KIND)
    batch = groups.batch_items(numbered, "b", "i", policy)
    want = sorted((x.b, order[x.i][1], x.text, x.completion, x.reasons) for x in batch.collect() if order[x.i][1] is not None)
    out = str(tmp_path / "out")
    write_stream(stream_batch_items(source(spark, tmp_path, rows), "b", "i", policy), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted((x.b, x.i, x.text, x.completion, x.reasons) for x in spark.read.parquet(out).collect() if x.i is not None) == want

    texts: dict[str, tuple] = {}
    composed = stream_compose(spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src")), "b", "i", policy)
    seen = []

    def keep(frame, n):
        seen.append(n)
        texts.update({x.b: (x.text, x.completion, x.reasons) for x in frame.collect()})

    composed.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4
    assert texts == {x.b: (x.text, x.completion, x.reasons) for x in groups.compose(batch, "b", "i").collect()}


def test_partial_summaries_of_a_stream(spark, tmp_path):
    policy = P.Policy(limits=P.Limits(max_output_bytes=3))
    rows = items(1)
    result = lambda df: df.select("b", fields.redact_field("note", F.col("value"), policy).alias("r"))
    path = str(tmp_path / "parts")
    keep_partial_summaries(result(source(spark, tmp_path, rows)), ["b"], "r", path, str(tmp_path / "cp")).awaitTermination()
    kept = merge_partials(spark.read.parquet(path), ["b"])
    whole = result(spark.createDataFrame(rows, KIND)).groupBy("b").agg(*merge_summaries("r"), F.count("r").alias("n_results"))
    assert spark.read.parquet(path).select("micro_batch").distinct().count() == 4
    assert sorted(map(tuple, kept.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_one_unknown_omission_hides_the_sum(spark):
    rows = [(1, 5), (1, None), (2, 3), (2, 4), (3, None)]
    usage = "struct<usage:struct<presented:long,inspected:long,output:long,nodes:long,items:long,depth:int,omitted:long>,completion:tinyint,reasons:int>"
    df = spark.createDataFrame([(k, ((1, 1, 1, 1, 1, 1, o), 0, 0)) for k, o in rows] + [(4, None)], f"k int, r {usage}")
    parts = partial_summaries(df, ["k"], "r")
    twice = parts.unionByName(parts)
    assert sorted((x.k, x.omitted, x.n_results) for x in merge_partials(twice, ["k"]).where("k <> 4").collect() if x.omitted is not None) == [(2, 14, 4)]
    assert merge_partials(twice, ["k"]).where("k in (1, 3)").where("omitted is null").count() == 2
    empty = merge_partials(parts, ["k"]).where("k = 4").collect()[0]
    assert (empty.n_results, empty.presented, empty.omitted) == (0, None, 0)
