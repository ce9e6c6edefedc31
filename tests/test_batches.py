"""Batches under one budget against items taken one after another, however long a batch is."""

import random

import pytest
from pyspark.sql import functions as F

from lacquer.functions import policy as P
from lacquer.operators import groups

KIND = "b string, i long, op string, name string, value string, content_type string"
OPS = ["literal", "field", "env", "json", "json_value", "uri", "http_url", "http_body", "shell", "process"]


def in_turn(spark, rows, policy):
    """Every item of every batch with what those before it left."""
    df = spark.createDataFrame(rows, KIND)
    prepared = df.select("b", "i", *groups.prepared(df, policy, "op", "name", "value")).orderBy("b", "i").collect()
    out, last, left = [], object(), 0
    for b, i, *item in map(tuple, prepared):
        if b != last:
            last, left = b, policy.limits.max_output_bytes
        text, completion, reasons, left = groups.spend(policy, tuple(item), left)
        out.append((b, i, text, completion, reasons))
    return sorted(out, key=str)


def item(r):
    op = r.choice(OPS)
    value = {
        "json": '{"token": "abc", "n": [1, 2]}', "json_value": '{"a": "bcd"}', "uri": "s3://u:p@bucket/key?token=t", "http_url": "https://h.example/p?token=t&x=yyyyyyyy#f", "http_body": '{"id": 7, "token": "x"}',
    }.get(op, r.choice(["", "plain", "longer text with words", "x" * r.randint(0, 30), "tab\there"]))
    return op, r.choice(["note", "password", "status", "blank"]), value, r.choice([None, "text/plain", "application/json", "application/x-www-form-urlencoded"])


@pytest.mark.parametrize("most", [0, 5, 11, 40, 130, 16_384])
def test_batches_of_all_formats(spark, most):
    r = random.Random(most)
    policy = P.standard().builder().fields(lambda x: x.low("status").medium("blank")).mask(P.MEDIUM, P.Mask.empty()).limits(max_output_bytes=most).build()
    rows = [(b, i, *item(r)) for b, n in (("hot", 400), ("a", 12), ("c", 3), ("d", 1), (None, 9), ("blank", 0)) for i in range(n)]
    rows += [("empty", i, "literal", "note", "", None) for i in range(60)] + [("empty", 60, "literal", "note", "x" * 50, None)] + [("empty", i, "literal", "note", "", None) for i in range(61, 90)]
    rows += [("masked", i, "field", "blank", "y" * (i % 50), None) for i in range(80)]
    df = spark.createDataFrame(rows, KIND).repartition(7)
    got = sorted(((x.b, x.i, x.text, x.completion, x.reasons) for x in groups.batch_items(df, "b", "i", policy).collect()), key=str)
    assert got == in_turn(spark, rows, policy)


@pytest.mark.parametrize("most", [0, 7, 100])
def test_batches_of_fields(spark, most):
    r = random.Random(most)
    policy = P.standard().builder().fields(lambda x: x.low("status")).limits(max_output_bytes=most).build()
    rows = [(b, i, "field", r.choice(["note", "password", "status"]), r.choice(["", "ab", "abcdef", "x\ty"]), None) for b, n in (("hot", 300), ("a", 5), (None, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = sorted(((x.b, x.i, x.text, x.completion, x.reasons) for x in groups.batch_fields(df, "b", "i", F.col("name"), F.col("value"), policy).collect()), key=str)
    assert got == in_turn(spark, rows, policy)


def test_a_batch_with_most_rows_is_spread_over_tasks(spark):
    df = spark.range(40_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("b"), "id", F.lit("ab").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else such few rows are one task's
    try:
        out = groups.batch_fields(df, "b", "id", "note", F.col("v"), P.standard())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = spark.read.parquet(*[f for f in out.inputFiles() if "/scan-" in f]).select("b", "_metadata.file_path")
    sizes = [r.n for r in written.where("b = 0").groupBy("file_path").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 13_334 and len(sizes) > 1 and max(sizes) < 0.9 * sum(sizes)
    assert out.where("b = 0 and completion = 0").count() == 8192 and out.where("b <> 0 and completion <> 0").count() == 0


def test_batches_of_nothing(spark):
    df = spark.createDataFrame([], KIND)
    assert groups.batch_items(df, "b", "i", P.standard()).collect() == [] and groups.batch_fields(df, "b", "i", "note", F.col("value"), P.standard()).collect() == []
