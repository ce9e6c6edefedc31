"""Column expressions against their Python twins and known texts."""

import pickle
import random

import pytest
from pyspark.sql import functions as F, types as T

from lacquer.functions import policy as P
from lacquer.functions.masks import by_level, escaped, masked, quoted, written
from lacquer.functions.names import candidates, candidates_column, canonical, canonical_column, key_level, level_column
from lacquer.operators import fields, frames, groups
from lacquer.operators.results import BIT, merge_summaries, reason_names
from lacquer.sources import read_redacted, write_redacted

NAMES = ["password", "OPENAI_ACCESS_TOKEN", "HTTPServer2Token", "_id", " access[token] ", "ÜberToken", "page", "", "  ", "x-api-key", "myPasswordHint", "diagnosticToken", "a.b.c", None]


def test_names_as_columns(spark):
    policies = [P.standard(), P.strict(), P.Policy(rules=P.Rules((("token", P.LOW), ("c", P.MEDIUM)), ("accesstoken",), ("hint", "token"), True, P.HIGH), floor=None)]
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    rows = df.select("n", candidates_column(F.col("n")).alias("c"), *(level_column(F.col("n"), p).alias(f"l{k}") for k, p in enumerate(policies))).collect()
    for r in rows:
        if r.n is None:
            continue
        assert tuple(r.c) == candidates(r.n)
        for k, p in enumerate(policies):
            assert r[f"l{k}"] == p.sensitivity_for(r.n), (r.n, k)


def test_masks_as_columns(spark):
    values = ["", "a", "ab", "abcd", "abcde", "密钥值", "\U0001f600x\U0001f600yz", None]
    kinds = [*P.MASKS, P.Mask.empty(), P.Mask.preserve_edges(1, 0, "#", 0), P.Mask.preserve_suffix(0, "#", 2)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", *(masked(F.col("v"), m).alias(f"m{k}") for k, m in enumerate(kinds)), *(written(F.col("v"), m).alias(f"w{k}") for k, m in enumerate(kinds)), by_level(F.col("v"), F.lit(2), P.standard()).alias("b")).collect()
    for r in rows:
        for k, m in enumerate(kinds):
            assert r[f"m{k}"] == (None if r.v is None else m.mask(r.v))
            assert r[f"w{k}"] == (None if r.v is None else m.written(r.v))
        assert r.b == (None if r.v is None else P.MASKS[1].mask(r.v))


def test_escapes(spark):
    text = "a\n\r\t\0\x1b\x7f؜‎ ‮⁦\\\"\U0001f600"
    r = spark.createDataFrame([(text,)], "v string").select(escaped(F.col("v")).alias("e"), quoted(F.lit('a"b\\c\n​')).alias("q")).first()
    assert r.e == "a\\n\\r\\t\\0\\u{1b}\\u{7f}\\u{61c}\\u{200e}\\u{2028}\\u{202e}\\u{2066}\\\"\U0001f600"
    assert r.q == '"a\\"b\\\\c\\n\\u{200b}"'


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pair(name, value):
    return F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"))


def item(value, level=None):
    v = F.lit(value)
    return F.struct(v.cast("binary").alias("value"), F.lit(level).cast("string").alias("sensitivity"))


def test_fields(spark):
    s = P.standard()
    assert one(spark, fields.redact_field("password", F.lit(""), s)).text == "<redacted>"
    assert one(spark, fields.redact_field("page", F.lit("a\nb"), s)).text == "a\\nb"
    assert one(spark, fields.redact_field("page", F.lit(None).cast("string"), s)) is None
    tight = s.builder().limits(max_output_bytes=1).build()
    r = one(spark, fields.redact_field("page", F.lit("long"), tight))
    assert (r.text, r.completion, r.reasons) == ("", 2, BIT["output_limit_reached"])
    assert one(spark, fields.redact_field("password", F.lit("long"), tight)).text == ""
    assert one(spark, fields.redact_field(F.lit("my_token"), F.lit("long"), s)).text == "****"
    assert one(spark, fields.redact_field("password", F.lit("x"), P.disabled())).text == "x"
    assert one(spark, fields.inspect_field("token", F.lit(""), s)).max_sensitivity == P.HIGH
    assert one(spark, fields.inspect_field("page", F.lit("x"), s)).max_sensitivity is None


def test_a_secret_column_is_never_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x")], "id int, password string").write.parquet(path)
    df = read_redacted(spark, path, P.standard())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int>" in plan
    assert df.first().password == "<redacted>"
    write_redacted(spark.createDataFrame([("u", "abcdefgh")], "user string, license_key string"), str(tmp_path / "o"), P.standard())
    assert spark.read.parquet(str(tmp_path / "o")).first().license_key == "*******h"


def test_environment(spark):
    s = P.standard()
    assert one(spark, fields.redact_env(F.lit("PASSWORD"), F.lit("x"), s)).text == "PASSWORD=<redacted>"
    assert one(spark, fields.redact_env(F.lit("MODE"), F.lit("debug"), s)).text == "MODE=debug"
    assert one(spark, fields.redact_env(F.lit("MODE"), F.unhex(F.lit("FF")), s)).text == "MODE=<redacted>"
    assert one(spark, fields.redact_env(F.lit("TOKEN"), F.lit(""), s)).text == "TOKEN="
    pairs = F.array(pair("A", 'q"\n'), pair("API_KEY", "y"))
    assert one(spark, fields.redact_env_pairs(pairs, s)).text == '["A=q\\"\\\\n", "API_KEY=****"]'
    assert one(spark, fields.inspect_env_pairs(pairs, s)).max_sensitivity == P.HIGH
    few = s.builder().limits(max_items=1).build()
    r = one(spark, fields.redact_env_pairs(pairs, few))
    assert (r.text, r.completion, r.reasons) == ("<truncated>", 1, BIT["traversal_limit_reached"])
    assert not one(spark, fields.inspect_env_pairs(pairs, few)).ok


def test_arguments(spark):
    s = P.standard()
    line = ["client", "--password", "separate-secret", "--token=inline-secret", "OPENAI_API_KEY=assignment-secret", "-Dmy.secret=jvm", "-v", "shown", "--password", "--token", "chained", "rest"]
    text = one(spark, fields.redact_heuristic_argv(F.array(*map(item, line)), s)).text
    assert text == '["client", "--password", "<redacted>", "--token=****", "OPENAI_API_KEY=****", "-Dmy.secret=<redacted>", "-v", "shown", "--password", "<redacted>", "****", "rest"]'
    shell = ["sh", "-c", "echo --password shell-secret", "-pCOMPACT"]
    assert one(spark, fields.redact_heuristic_argv(F.array(*map(item, shell)), s)).text == '["sh", "-c", "echo --password shell-secret", "-pCOMPACT"]'
    assert one(spark, fields.redact_argv(F.array(item("a"), item("secretvalue", "low")), s)).text == '["a", "se****ue"]'
    broken = F.array(F.struct(F.unhex(F.lit("61FF")).alias("value"), F.lit("secret").alias("sensitivity")), item("b"))
    assert one(spark, fields.redact_argv(broken, s)).text == '["<redacted>", "b"]'
    armed = F.array(F.struct(F.unhex(F.lit("61FF")).alias("value"), F.lit(None).cast("string").alias("sensitivity")), item("b"), item("c"))
    assert one(spark, fields.redact_heuristic_argv(armed, s)).text == '["<redacted>", "<redacted>", "c"]'
    single = F.array(*map(item, ["-token", "x", "-my-token", "y"]))
    assert one(spark, fields.redact_heuristic_argv(single, s)).text == '["-token", "****", "-my-token", "y"]'
    assert one(spark, fields.inspect_argv(single, s, heuristic=True)).max_sensitivity == P.HIGH


def test_process(spark):
    env = F.array(pair("PASSWORD", "x"))
    args = F.array(item("--v"))
    assert one(spark, fields.redact_process(F.lit("client"), args, env, P.standard())).text == '["client", "--v"]["PASSWORD=<redacted>"]'
    few = P.standard().builder().limits(max_items=1).build()
    r = one(spark, fields.redact_process(F.lit("client"), F.array().cast("array<struct<value:binary,sensitivity:string>>"), env, few))
    assert (r.text, r.completion, r.reasons) == ("", 1, BIT["traversal_limit_reached"])
    assert one(spark, fields.inspect_process(F.lit("client"), args, env, P.standard())).max_sensitivity == P.SECRET


def test_headers(spark):
    h = lambda n, v, s=False: F.struct(F.lit(n).alias("name"), F.lit(v).cast("binary").alias("value"), F.lit(s).alias("sensitive"))
    headers = F.array(h("X-Visible", "visible"), h("native", "flagged", True), h("Authorization", "raw"), h("x-visible", "two"), h("odd", "é"))
    assert one(spark, fields.redact_http_headers(headers, P.standard())).text == "authorization: [****]\nnative: [<redacted>]\nodd: [<non-utf8>]\nx-visible: [visible, two]"
    assert one(spark, fields.inspect_http_headers(headers, P.standard())).max_sensitivity == P.SECRET


def test_shapes(spark):
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()), T.StructField("who", T.StructType([T.StructField("name", T.StringType(), True, {"redact": "low"}), T.StructField("token", T.StringType())])),
            T.StructField("bag", T.MapType(T.StringType(), T.StringType())), T.StructField("note", T.StringType(), True, {"redact": "skip"}), T.StructField("raw", T.StringType(), True, {"redact": "json"}),
        ]
    )
    df = spark.createDataFrame([(1, ("abcdefgh", "t"), {"password": "x", "k": "v"}, "n", '{"secret": 1, "a": [1.50]}'), (2, None, None, None, None)], schema)
    a, b = frames.redact_columns(df, P.standard()).orderBy("id").collect()
    assert (a.who.name, a.who.token, a.bag, a.raw) == ("****", "****", {"password": "<redacted>", "k": "v"}, '{"secret":"<redacted>","a":[1.50]}')
    assert (b.who, b.bag, b.raw) == (None, None, None) and "note" not in a
    text = df.select("id", frames.debug_text(F.struct("id", "who", "bag"), T.StructType(schema.fields[:3]), P.standard(), "Row").alias("t")).orderBy("id").collect()
    assert text[0].t == 'Row { id: 1, who: who { name: "\\"a****h\\"", token: "****" }, bag: {"password": "<redacted>", "k": "v"} }'
    assert text[1].t == "Row { id: 2, who: None, bag: None }"
    report = {r.column: r.max_sensitivity for r in frames.inspect_columns(df, P.standard()).collect()}
    assert report == {"id": None, "who": P.HIGH, "bag": None, "note": None, "raw": None}
    levels = df.select(frames.inspect_struct(F.col("bag"), schema["bag"].dataType, P.standard()).alias("x")).collect()
    assert levels[0].x.max_sensitivity == P.SECRET and levels[1].x is None


def test_report_and_rules(spark):
    df = spark.createDataFrame([("a", "token"), ("a", "page"), ("b", "page"), ("b", None)], "g string, n string")
    rows = {r.g: (r.n_rows, r.n_max, r.n_sensitive) for r in frames.sensitivity_report(df, ["g"], {"n": F.col("n")}, P.standard()).collect()}
    assert rows == {"a": (2, 3, 1), "b": (2, 0, 0), None: (4, 3, 1)}
    assert frames.rules_df(spark, P.standard()).where("layer = 'floor'").count() == len(P.STANDARD_FLOOR.sensitive)
    policy = P.Policy(rules=P.Rules((("token", 3), ("same", 2)), ("same", "accesstoken"), ("hint",)))
    names = [n for n in NAMES if n is not None] + ["same", "my_same", "access_token", "x_hint"]
    got = {r.name: (r.kind, r.rule, r.match) for r in frames.classify_names(spark.createDataFrame([(n,) for n in names], "n string"), "n", policy).collect()}
    assert got == {n: policy.classify_field(n) for n in names}


@pytest.mark.parametrize("most", [1, 4, 9, 14, 100])
def test_batches_share_a_budget(spark, most):
    policy = P.Policy(rules=P.rules_of({"f": P.LOW}), limits=P.Limits(max_output_bytes=most))
    items = [(b, i, "field", "f" if i % 2 else "g", v) for b in (1, 2) for i, v in enumerate(["abcdefgh", "xy", "", "longer value", "z"][: 3 + b])]
    df = spark.createDataFrame(items, "b int, i int, op string, name string, value string")
    left, expected = {1: most, 2: most}, []
    for b, i, op, name, value in items:
        shown = policy.masks[0].written(value) if name == "f" else value
        text, completion, reasons, left[b] = groups.spend(policy, (op, None, None, shown, len(value)), left[b])
        expected.append((b, i, text, completion, reasons))
    fold = sorted(tuple(r) for r in groups.batch_items(df, "b", "i", policy).collect())
    assert fold == expected
    window = sorted(tuple(r) for r in groups.batch_fields(df, "b", "i", F.col("name"), F.col("value"), policy).collect())
    assert window == expected
    composed = {r.b: r.text for r in groups.compose(groups.batch_items(df, "b", "i", policy), "b", "i").collect()}
    assert composed == {b: "".join(e[2] for e in expected if e[0] == b) for b in (1, 2)}
    assert all(len(t.encode()) <= most for t in composed.values())


def test_handles(spark):
    items = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "b int, i int, text string")
    handles = spark.createDataFrame([(1, 1), (1, 7), (2, 0)], "b int, i int")
    got = {(r.b, r.i): (r.text, r.error) for r in groups.resolve(items, handles, "b", "i").collect()}
    assert got == {(1, 1): ("b", None), (1, 7): (None, "missing_item"), (2, 0): (None, "different_batch")}


def test_summaries_merge(spark):
    tight = P.standard().builder().limits(max_output_bytes=5).build()
    df = spark.createDataFrame([("abc",), ("abcdefgh",)], "v string").select(fields.redact_field("page", F.col("v"), tight).alias("r"))
    s = df.agg(*merge_summaries("r")).first()
    assert (s.completion, s.reasons, s.output, s.omitted) == (2, BIT["output_limit_reached"], 3, 0)
    assert one(spark, reason_names(F.lit(BIT["invalid_json"] | BIT["invalid_uri"]))) == ["invalid_json", "invalid_uri"]


def test_names_as_columns_and_in_python_agree(spark):
    """Of names of any blanks, separators, cases and scripts."""
    r = random.Random(11)
    parts = ["api", "key", "Token", "password", "PASSWORD", "x", "HTTP", "9", "É", "Σ", "ς", "ǅ", "İ", "一", "²", "_", "-", ".", "[", "]", " ", "\t", "\u0085", " ", " ", "　", " ", " ", "\x1c", "\x1f", "​", "﻿"]
    names = ["".join(r.choice(parts) for _ in range(r.randint(0, 6))) for _ in range(1500)]
    names += ["api key", "api　key", "API\u0085KEY", "x password", "api\x1ckey", "apiKey", "", " "]
    policy = P.standard().builder().fields(lambda b: b.allow_exact("x password").allow_suffix("xtoken").low("é", "σ", "x")).build()
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", level_column(F.col("n"), policy).alias("level"), canonical_column(F.col("n")).alias("c"))
    for row in df.collect():
        assert (row.level, row.c) == (policy.sensitivity_for(row.n), canonical(row.n)), ascii(row.n)
    for name, level in (("api key", 3), ("api　key", 3), ("API\u0085KEY", 3), ("x password", 4), ("api\x1ckey", 0)):
        assert P.standard().sensitivity_for(name) == level


def test_items_of_unknown_operations_show_nothing(spark):
    rows = [(1, 0, "argv", "n", "--password hunter2"), (1, 1, "json_value", "n", '{"password":"p"}'), (1, 2, "whatever", "page", "raw"), (1, 3, None, "page", "raw"), (1, 4, "field", None, "shown"), (1, 5, "literal", None, None)]
    df = spark.createDataFrame(rows, "b int, i int, op string, name string, value string")
    got = {r.i: (r.text, r.completion, r.reasons) for r in groups.batch_items(df, "b", "i", P.standard()).collect()}
    hidden = ("<redacted>", 0, BIT["unsupported_content_type"])
    assert got == {0: ("[]", 0, 0), 1: ('{"password":"<redacted>"}', 0, 0), 2: hidden, 3: hidden, 4: ("shown", 0, 0), 5: ("", 0, 0)}


def test_lists_and_addresses_of_a_batch_spend_its_budget(spark):
    args = [("--password", None), ("hunter2", None)]
    rows = [(b, i, op, "https://h.example/a/long/path", args) for b, ops in enumerate([("http_url", "heuristic_argv", "literal"), ("heuristic_argv", "http_url"), ("literal", "http_url", "argv")]) for i, op in enumerate(ops)]
    df = spark.createDataFrame(rows, "b int, i int, op string, value string, args array<struct<value:string,sensitivity:string>>").withColumn("name", F.lit("x"))
    show = lambda most: [[r.text for r in sorted(groups.batch_items(df, "b", "i", P.Policy(limits=P.Limits(max_output_bytes=most))).collect(), key=lambda r: (r.b, r.i)) if r.b == b] for b in range(3)]
    url, argv = "https://h.example/a/long/path", '["--password", "<redacted>"]'
    assert show(1000) == [[url, argv, url], [argv, url], [url, url, '["--password", "hunter2"]']]
    assert show(40) == [[url, "<truncated>", ""], [argv, "h<truncated>"], [url, "<truncated>", ""]]
    assert show(20) == [["https://h<truncated>", "", ""], ["<truncated>", ""], ["", "", ""]]


def test_builders_check_what_they_are_given():
    with pytest.raises(P.PolicyError):
        P.validate_field_name(" _-")
    assert P.validate_field_name(" Api-Key ") == "apikey"
    for bad in ({"max_items": -1}, {"max_depth": "3"}, {"max_output_bytes": (1 << 31) + 1}):
        with pytest.raises(P.PolicyError):
            P.standard().builder().limits(**bad)
    assert P.Mask.preserve_edges(1, 1, "é", 0).bounded("abcd", 2) == ("a", True) and P.Mask.fixed("xy").bounded("", 1) == ("", False)
    policy = P.standard()
    policy.sensitivity_for("token")
    assert P.Policy.from_json(policy.to_json()) == policy and pickle.loads(pickle.dumps(policy)) == policy


def test_sets_of_names_of_any_size(spark):
    import random

    r = random.Random(11)
    for n in (1, 3, 100, 101, 5000):
        names = {f"{r.choice(['code', 'Key', 'x_y', 'ключ'])}{r.randrange(10**5)}": r.randint(1, 4) for _ in range(n)}
        allowed = tuple(P.canonical(x) for x in r.sample(sorted(names), n // 5))
        policy = P.Policy(rules=P.rules_of(names, allow_suffix=allowed, allow_exact=tuple(P.canonical(x) for x in r.sample(sorted(names), n // 7))), floor=None)
        asked = [*r.sample(sorted(names), min(n, 60)), *(f"app-{x}" for x in r.sample(sorted(names), min(n, 60))), "", "_", "other", "code", "\n", "code1\ncode2"]
        got = spark.createDataFrame([(x,) for x in asked], "x string").select("x", level_column(F.col("x"), policy).alias("n")).collect()
        assert [(g.x, g.n) for g in got] == [(x, policy.sensitivity_for(x)) for x in asked]


def test_lists_are_rendered_once(spark):
    """Of arguments and processes the plan holds one rendering, and none of the work on names that lambdas would repeat for every item."""
    items = "array<struct<value:binary,sensitivity:string>>"
    df = spark.createDataFrame([([(b"--api-key", None), (b"x", None)], [(b"A", b"b")])], f"args {items}, env array<struct<name:binary,value:binary>>")
    for column in (fields.redact_heuristic_argv(F.col("args"), P.standard()), fields.redact_process(F.lit("c"), F.col("args"), F.col("env"), P.standard())):
        plan = df.select(column.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan and plan.count("array_join(") <= 6 and "IsUppercase" not in plan


def test_lists_are_scanned_by_batches(spark):
    """No lambda quotes or measures single items of a heuristic list; lists of a batch do not reach into one another."""
    lists = [
        [("a", None), ("--password", None)], [("b", None)], None, [], [("--token", None)], [(None, None), ("c", None)], [("d", "low"), ("e", "bogus"), ("f", "0")],
        [("-p\u0301", None), ('q"\\\n', None)], [("--password", "0"), ("longer", "low"), ("A_TOKEN=x", None)], [("x", None)] * 3,
    ]
    df = spark.createDataFrame(list(enumerate(lists)), "k int, args array<struct<value:string,sensitivity:string>>").coalesce(1)
    policy = P.standard().builder().limits(max_items=2).build()
    out = df.select("k", fields.redact_heuristic_argv(F.col("args"), P.standard()).alias("r"), fields.redact_heuristic_argv(F.col("args"), policy).alias("few"), fields.inspect_argv(F.col("args"), P.standard(), True).alias("i"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan and "aggregate(" not in plan
    got = sorted(out.collect())
    texts = ['["a", "--password"]', '["b"]', None, "[]", '["--token"]', '["<redacted>", "<redacted>"]', '["****", "f"]', r'["-p\u{301}", "q\"\\\n"]', '["--password", "lo****er", "A_TOKEN=****"]', '["x", "x", "x"]']
    assert [g.r and g.r.text for g in got] == texts
    assert [g.r and g.r.usage.presented for g in got] == [11, 1, None, 0, 7, 1, 3, 8, 25, 3]
    assert [g.i and g.i.max_sensitivity for g in got] == [None, None, None, None, None, P.SECRET, P.LOW, None, P.HIGH, None]
    assert [g.few and g.few.text for g in got] == [t if t is None or len(x) <= 2 else "<truncated>" for x, t in zip(lists, texts, strict=True)]


def test_a_long_field_is_escaped_once(spark):
    text = "a\tb\n\r\0c\u2028\u202e\\n\"" * 3
    df = spark.createDataFrame([(text,), ("",), (None,), ("x" * 20_000,)], "t string")
    out = df.select(fields.redact_field("body", F.col("t"), P.standard()).alias("r"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("\\p{Cc}") <= 2
    got = [x.r and (x.r.text, x.r.completion) for x in out.collect()]
    assert got == [("a\\tb\\n\\r\\0c\\u{2028}\\u{202e}\\n\"" * 3, 0), ("", 0), None, ("", 2)]


def test_a_share_of_a_large_set_is_short(spark):
    from lacquer.functions.names import among

    names = [f"code{i}" for i in range(2_000)]
    found = among(names)(F.col("name"))
    assert max(len(x.split("\n")) for x in str(found).split("\r")) < 40
    rows = spark.createDataFrame([(n,) for n in (*names, "code", "code2000", "ode1", "")], "name string")
    assert rows.where(found).count() == 2_000


def test_keys_without_letters_are_looked_up_only_for_rules_of_such_names(spark):
    df = spark.sql("select 7 as n, -12L as l, date'2020-02-02' as d, 'api_key' as s")
    kinds = {"n": T.IntegerType(), "l": T.LongType(), "d": T.DateType(), "s": T.StringType()}
    for own in (P.standard(), P.standard().builder().fields(lambda r: r.high("7").low("12").secret("0202")).build(), P.standard().builder().floor(lambda r: r.medium("20200202")).build()):
        got = df.select(*(key_level(F.col(c), k, own).alias(c) for c, k in kinds.items())).first()
        assert got == df.select(*(level_column(F.col(c).cast("string"), own).alias(c) for c in kinds)).first()
    plan = df.select(key_level(F.col("n"), T.IntegerType(), P.standard()).alias("n"))._jdf.queryExecution().analyzed().toString()
    assert "split" not in plan and "transform" not in plan
