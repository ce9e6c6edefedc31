"""Structured values: no secret survives any shape, limits end the text, and plans grow with the fields."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F, types as T

from lacquer.functions import policy as P
from lacquer.functions.masks import bounded
from lacquer.operators import fields, frames, structures

SECRET = "hunter2"
KEYS = [(T.StringType(), "plain"), (T.IntegerType(), 7), (T.DateType(), datetime.date(2020, 1, 2)), (T.StructType([T.StructField("k", T.StringType())]), (SECRET,)), (T.LongType(), 8)]


def shape(r, depth):
    """A random type with a value in which SECRET stands only under names that have a level, or in keys that are no names."""
    kind = r.choice(["struct", "array", "map", "leaf"]) if depth else "leaf"
    if kind == "leaf":
        return T.StructType([T.StructField("password", T.StringType()), T.StructField("n", T.LongType())]), (SECRET, 5)
    inner, value = shape(r, depth - 1)
    if kind == "struct":
        return T.StructType([T.StructField("a", inner), T.StructField("api_key", T.ArrayType(T.StringType())), T.StructField("b", T.StringType())]), (value, [SECRET], "free")
    if kind == "array":
        return T.ArrayType(inner), [value, None, value]
    key, k = r.choice(KEYS)
    return T.MapType(key, inner), {k: value}


@pytest.mark.parametrize("seed", range(12))
def test_no_secret_survives_a_shape(spark, seed):
    r = random.Random(seed)
    kind, value = shape(r, 4)
    df = spark.createDataFrame([(value,), (None,)], T.StructType([T.StructField("v", kind)]))
    assert frames.schema_level(kind, P.standard()) == P.SECRET
    out = frames.redact_columns(df, P.standard())
    texts = df.select(
        frames.debug_text(F.col("v"), kind, P.standard()).alias("a"), frames.redact_struct_json(F.col("v"), kind, P.standard()).alias("b"),
        frames.redact_value(F.col("v"), kind, P.standard())["text"].alias("c"), frames.inspect_struct(F.col("v"), kind, P.standard()).alias("i"),
    ).collect()
    assert SECRET not in str(out.collect()) and SECRET not in str(texts)
    assert "5" in str(texts) or "?" in str(texts)
    assert texts[0].i.max_sensitivity == P.SECRET and texts[0].a == texts[0].c and texts[1].a == "None" and texts[1].i is None


def test_levels_in_maps_of_maps(spark):
    df = spark.createDataFrame([({1: [{"x": 1}]},), ({1: [{"token": 1}]},), ({},), (None,)], "m map<int, array<map<string, int>>>")
    got = df.select(frames.inspect_struct(F.col("m"), df.schema["m"].dataType, P.standard())["max_sensitivity"].alias("n")).collect()
    assert [r.n for r in got] == [None, P.HIGH, None, None]


def test_variants_are_redacted_as_json(spark):
    df = spark.sql("""select parse_json('{"password": "hunter2", "n": 1}') v, named_struct('v', parse_json('{"token": ["hunter2"]}')) s""")
    text = df.select(frames.debug_text(F.col("s"), df.schema["s"].dataType, P.standard(), "S").alias("t")).collect()[0].t
    assert SECRET not in str(frames.redact_columns(df, P.standard()).collect()) and SECRET not in text
    assert text == r'S { v: "{\"token\":\"****\"}" }'


def test_a_level_comes_before_a_types_redaction_and_a_callers_mask_before_both(spark):
    frames.register_redaction("loud", lambda c: F.concat(F.lit("own "), c))
    schema = T.StructType([T.StructField("password", T.StringType(), metadata={"type": "loud"}), T.StructField("x", T.StringType(), metadata={"type": "loud"})])
    df = spark.createDataFrame([(SECRET, "y")], schema)
    assert tuple(frames.redact_columns(df, P.standard()).collect()[0]) == ("<redacted>", "own y")
    assert tuple(frames.redact_columns(df, P.standard(), {"password": lambda c: F.length(c)}).collect()[0]) == (7, "own y")


def granted(policy, charges):
    """How many charges (nodes, items) fit."""
    n = i = 0
    for k, (a, b) in enumerate(charges):
        n, i = n + a, i + b
        if n > policy.limits.max_nodes or i > policy.limits.max_items:
            return k
    return len(charges)


@pytest.mark.parametrize("most", [(256, 1024), (3, 1024), (256, 7), (0, 3), (5, 5)])
def test_limits_of_items_and_nodes(spark, most):
    policy = P.standard().builder().limits(max_items=most[0], max_nodes=most[1]).build()
    kind = T.StructType([T.StructField("a", T.LongType()), T.StructField("xs", T.ArrayType(T.LongType())), T.StructField("m", T.MapType(T.StringType(), T.LongType())), T.StructField("z", T.LongType())])
    rows = [(i, list(range(i)), {f"k{j}": j for j in range(i % 4)}, None) for i in range(9)]
    df = spark.createDataFrame([(r,) for r in rows], T.StructType([T.StructField("v", kind)]))
    got = df.select(frames.redact_value(F.col("v"), kind, policy, "R").alias("r"), frames.inspect_struct(F.col("v"), kind, policy).alias("i")).collect()
    for (a, xs, m, _), g in zip(rows, got, strict=True):
        parts, charges, refused = ["R { ", f"a: {a}", ", ", "xs: ", "["], [(1, 0), (1, 0), (0, 0), (1, 0), (1, 0)], ["<truncated>", "...: <truncated><truncated>", "", "...: <truncated><truncated>", "<truncated>"]
        for k, x in enumerate(xs):
            parts += [", " if k else "", str(x)]
            charges += [(0, 0), (0, 1)]
            refused += ["", "<truncated><truncated>"]
        parts += ["]", ", ", "m: ", "{"]
        charges += [(0, 0), (0, 0), (1, 0), (0, 0)]
        refused += ["", "", "...: <truncated><truncated>", ""]
        for k, (key, v) in enumerate(m.items()):
            parts += [", " if k else "", f'"{key}": {v}']
            charges += [(0, 0), (0, 1)]
            refused += ["", "...: <truncated><truncated>"]
        parts += ["}", ", ", "z: None", " }"]
        charges += [(0, 0), (0, 0), (1, 0), (0, 0)]
        refused += ["", "", "...: <truncated><truncated>", ""]
        k = granted(policy, charges)
        assert g.r.text == "".join(parts[:k]) + (refused[k] if k < len(parts) else "")
        assert (g.r.completion, g.r.reasons) == ((0, 0) if k == len(parts) else (1, 4)) and g.i.ok == (k == len(parts)) and g.i.reasons == g.r.reasons
        assert (g.r.usage.nodes, g.r.usage.items) == (sum(c[0] for c in charges[:k]), sum(c[1] for c in charges[:k]))


def test_nine_hundred_items_are_over_the_standard_limit(spark):
    df = spark.range(1).select(F.struct(F.sequence(F.lit(1), F.lit(900)).alias("xs")).alias("v"))
    r = df.select(frames.redact_value(F.col("v"), df.schema["v"].dataType, P.standard(), "R").alias("r")).collect()[0].r
    assert r.text.endswith(", 255, 256, <truncated><truncated>") and r.completion == 1 and r.usage["items"] == 256


def chain(depth, level=None):
    kind = T.LongType()
    for k in range(depth):
        kind = T.StructType([T.StructField("n" if k or not level else "leaf", kind, metadata={"redact": level} if level and k % 2 else {})])
    return kind


@pytest.mark.parametrize("level", [None, "low"])
def test_a_plan_grows_with_the_fields(spark, level):
    sizes, began = [], time.time()
    for depth in (4, 8, 16):
        kind = chain(depth, level)
        df = spark.createDataFrame([], T.StructType([T.StructField("v", kind)])).select(frames.debug_text(F.col("v"), kind, P.standard()).alias("t"))
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[2] < 6 * sizes[1] < 36 * sizes[0]
    assert time.time() - began < 30
    assert structures.count_of(F.col("v"), chain(32), P.standard()).most == (64, 0, 32)


def test_a_cut_keeps_replacement_characters(spark):
    texts = ["ab�cd", "a�", "aé�é", "日本語テキスト", "\U0001f600\U0001f600"]
    for most in range(1, 12):
        got = [r.t for r in spark.createDataFrame([(x,) for x in texts], "x string").select(bounded(F.col("x"), most)["text"].alias("t")).collect()]
        assert got == [x.encode()[:most].decode("utf-8", "ignore") for x in texts]
    tight = P.standard().builder().limits(max_output_bytes=16).build()
    assert spark.range(1).select(fields.bounded_text(F.lit("ab�cdefghijklmnop"), tight).alias("t")).collect()[0].t == "ab�<truncated>"


def test_paths_of_json(spark):
    rows = ['{"a b":1,"c":[{"d":2},{"d":"x"}],"OBJECT<":{"g":null},"h`i":1.5,"token":{"x":[true]}}', '{"a b":2.5,"c":[],"z":{"password":"x"}}', "nope", None]
    got = {tuple(r) for r in frames.discover_json(spark.createDataFrame([(x,) for x in rows], "j string"), "j", P.standard()).collect()}
    assert got == {
        ("a b", "DECIMAL(21,1)", None), ("c", "ARRAY", None), ("c[]", "STRUCT", None), ("c[].d", "VARIANT", None), ("OBJECT<", "STRUCT", None), ("OBJECT<.g", "VOID", None), ("h`i", "DECIMAL(2,1)", None),
        ("token", "STRUCT", P.HIGH), ("token.x", "ARRAY", P.HIGH), ("token.x[]", "BOOLEAN", P.HIGH), ("z", "STRUCT", None), ("z.password", "STRING", P.SECRET),
    }
    one = lambda *texts: [tuple(r) for r in frames.discover_json(spark.createDataFrame([(x,) for x in texts], "j string"), "j", P.standard()).collect()]
    assert one("nope", None) == [] and one("[1]", '{"a":1}') == [("", "VARIANT", None)] and one("[1,2]") == [("[]", "BIGINT", None)] and one() == []
