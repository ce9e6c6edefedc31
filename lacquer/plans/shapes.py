"""Queries of formats, structures, inspections and groups, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.policy import HIGH, LOW, MEDIUM, SECRET, Policy, rules_of, standard
from ..operators import fields, formats, frames, groups
from ..operators.results import merge_partials, merge_summaries, partial_summaries
from .tables import LOW_WRITTEN, STANDARD_NAMES, table

PASSING = standard().builder().http(text_body="pass_through").build()
STATUS = Policy(rules=rules_of({"status": LOW, "priority": MEDIUM}))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def json_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs, arrays and maps as JSON values."""
    value = F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("api_key"), F.array("event_id", "user_id").alias("ids")).alias("who"), F.create_map("event_type", F.lit("m"), F.lit("session_id"), F.lit("n")).alias("more"))
    r = formats.redact_json_value(value, standard())
    return table(spark, sf_dir, "events").select("event_id", r["text"].alias("text"), formats.inspect_json_value(value, standard())["max_sensitivity"].cast("int").alias("level"))


def nested_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address in a query value, encoded once or twice, is redacted like the outer one."""
    inner = _text("https://inner.example/p?token=", F.col("page_id"), "&n=", F.col("page_id"))
    once, n = F.url_encode(inner), F.col("page_id") % 3
    url = _text("https://outer.example/?page=", F.col("page_id"), "&next=", F.when(n == 0, once).when(n == 1, F.url_encode(once)).otherwise("plain"))
    return table(spark, sf_dir, "pages").select("page_id", formats.redact_http_url(url, standard())["text"].alias("text"), formats.inspect_http_url(url, standard())["max_sensitivity"].cast("int").alias("level"))


def json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON by its content type, by a suffix of it, or by the first character; broken JSON and a source that went on."""
    n = F.col("page_id") % 5
    body = _text('{"id":', F.col("page_id"), ',"url":"', F.col("url"), '","refresh_token":"t"', F.when(n == 3, "").otherwise("}"))
    kind = F.when(n == 0, "application/json").when(n == 1, "application/problem+json; charset=utf-8").when(n == 3, "application/json").when(n == 4, "text/json")
    r = formats.redact_http_body(body, standard(), kind, source_truncated=n == 4, total_len=F.when(n == 4, F.octet_length(body) + 7))
    rows = table(spark, sf_dir, "pages").select("page_id", r.alias("r"))
    return rows.select("page_id", "r.text", "r.reasons", F.col("r.completion").cast("int").alias("completion"), F.col("r.usage.omitted").alias("omitted"))


def ndjson_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _text('{"id":', F.col("page_id"), ',"token":"t"}\n\n', F.when(F.col("page_id") % 4 == 0, "{broken").otherwise('{"url":"x"}'), "\n")
    return table(spark, sf_dir, "pages").select("page_id", formats.redact_http_body(body, standard(), F.lit("application/x-ndjson"))["text"].alias("text"))


def multipart_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "--b\r\nContent-Disposition: form-data; "
    parts = _text(
        head, 'name="id"\r\n\r\n', F.col("page_id"), "\r\n", head, 'name="session_id"\r\n\r\n', F.col("url"), "\r\n", head, 'name="file"; filename="f"\r\n\r\nraw\r\n',
        head, 'name="doc"\r\nContent-Type: application/json\r\n\r\n{"token":1,"n":', F.col("page_id"), "}\r\n", "--b", F.when(F.col("page_id") % 5 == 0, "").otherwise("--\r\n"),
    )
    return table(spark, sf_dir, "pages").select("page_id", formats.redact_http_body(parts, PASSING, F.lit("multipart/form-data; boundary=b"))["text"].alias("text"))


def other_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no text, a text that may pass, none, a type that is not known, and a broken type."""
    n = F.col("page_id") % 5
    body = F.when(n == 0, F.unhex(F.repeat(F.lit("ff00"), (F.col("page_id") % 90 + 1).cast("int")))).when(n == 2, F.lit(b"")).otherwise(_text("page\t", F.col("url")).cast("binary"))
    kind = F.when(n == 1, "text/plain").when(n == 3, "application/zip").when(n == 4, "broken")
    rows = table(spark, sf_dir, "pages").select("page_id", formats.redact_http_body(body, PASSING, kind).alias("r"))
    return rows.select("page_id", "r.text", "r.reasons")


#: Orders as a structure with every annotation.
ORDER = T.StructType(
    [
        T.StructField("kind", T.StringType(), metadata={"redact": "variant"}), T.StructField("id", T.LongType()), T.StructField("status", T.StringType(), metadata={"redact": "low"}),
        T.StructField("raw", T.StringType(), metadata={"redact": "json"}), T.StructField("hidden", T.StringType(), metadata={"redact": "skip"}),
        T.StructField("place", T.StructType([T.StructField("_1", T.LongType()), T.StructField("_2", T.StringType())]), metadata={"name": "Pair"}), T.StructField("tags", T.ArrayType(T.StringType()), metadata={"items": "medium"}),
        T.StructField("plain", T.ArrayType(T.LongType())), T.StructField("by_key", T.MapType(T.StringType(), T.LongType())), T.StructField("entries", T.MapType(T.StringType(), T.StringType()), metadata={"entries": "high"}),
        T.StructField("maybe", T.LongType(), metadata={"optional": True}), T.StructField("card", T.StringType(), metadata={"type": "order_priority"}),
    ]
)


def _order() -> Column:
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    return F.struct(
        F.when(key % 2 == 0, "Even").otherwise("Odd").alias("kind"), key.alias("id"), status.alias("status"), _text('{"token":1,"k":', key, "}").alias("raw"), F.lit("hidden").alias("hidden"),
        F.struct(F.col("o_custkey").alias("_1"), status.alias("_2")).alias("place"), F.array(priority).alias("tags"), F.array(key, key + 1).alias("plain"),
        F.create_map(F.lit("a"), key, F.lit("api_key"), key).alias("by_key"), F.create_map(status, priority).alias("entries"), F.when(key % 3 != 0, key).alias("maybe"), priority.alias("card"),
    ).cast(T.StructType([T.StructField(f.name, f.dataType) for f in ORDER.fields]))


frames.register_redaction("order_priority", lambda c: F.concat(F.lit("priority "), F.left(c, F.lit(1))))


def debug_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants, tuples, sequences, maps, JSON fields, optional values, skipped fields, levels of items and entries, and a type's own redaction."""
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.debug_text(_order(), ORDER, standard(), "Order").alias("text"))


#: Few items, nodes and levels, so that rows of small structures are within and over each.
NARROW = standard().builder().limits(max_items=5, max_nodes=14, max_depth=3).build()


def _basket(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, T.DataType]:
    """Orders with up to seven tags and three lines, a third of them with a structure of four levels."""
    key = F.col("o_orderkey")
    upto = lambda n: F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: i <= n)
    deep = F.when((F.floor(key / 32) % 3) == 0, F.struct(F.struct(F.struct(key.alias("y")).alias("z")).alias("x")))
    lines = F.transform(upto(F.floor(key / 8) % 4), lambda i: F.struct(i.alias("a"), key.alias("password")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(key.alias("id"), upto(key % 8).alias("tags"), lines.alias("lines"), deep.alias("deep")).alias("v"))
    return rows, rows.schema["v"].dataType


def structure_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures within and over the limits of items, nodes and depth: where the text ends, why, and what an inspection says."""
    rows, kind = _basket(spark, sf_dir)
    r, i = frames.redact_value(F.col("v"), kind, NARROW, "Basket"), frames.inspect_struct(F.col("v"), kind, NARROW)
    found = rows.select("o_orderkey", r.alias("r"), i.alias("i"))
    return found.select("o_orderkey", "r.text", F.col("r.completion").cast("int").alias("completion"), "r.reasons", F.col("r.usage.items").alias("n_items"), F.col("i.ok").alias("ok"), F.col("i.max_sensitivity").cast("int").alias("level"))


def structure_limits_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As JSON such a value is a secret as a whole."""
    rows, kind = _basket(spark, sf_dir)
    return rows.select("o_orderkey", frames.redact_struct_json(F.col("v"), kind, NARROW).alias("text"))


DEEPEST = standard().limits.max_depth


def deep_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of as many levels as the limit allows, and one of a level more."""
    value = F.struct(F.col("o_orderkey").alias("n"))
    for _ in range(DEEPEST - 1):
        value = F.struct(value.alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", value.alias("within"), F.struct(value.alias("n")).alias("over"))
    return rows.select("o_orderkey", *(frames.debug_text(F.col(c), rows.schema[c].dataType, standard(), "n").alias(c) for c in ("within", "over")))


#: Maps whose keys are no strings, with secrets in their values.
KEYED = T.StructType(
    [
        T.StructField("by_number", T.MapType(T.IntegerType(), T.StructType([T.StructField("password", T.StringType()), T.StructField("n", T.LongType())]))),
        T.StructField("by_day", T.MapType(T.DateType(), T.ArrayType(T.MapType(T.StringType(), T.StringType())))),
        T.StructField("by_struct", T.MapType(T.StructType([T.StructField("token", T.StringType())]), T.StringType())),
    ]
)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    value = F.struct(
        F.create_map((key % 7).cast("int"), F.struct(F.concat(F.lit("hunter"), key).alias("password"), key.alias("n"))).alias("by_number"),
        F.create_map(F.lit("2020-02-02").cast("date"), F.array(F.create_map(F.lit("api_key"), status, F.lit("plain"), status))).alias("by_day"), F.create_map(F.struct(status.alias("token")), status).alias("by_struct"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", value.cast(KEYED).alias("v"), F.array(value.cast(KEYED)).alias("vs"))


def keyed_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values under keys of numbers and days are redacted as under names; where keys are structures all of the map is a secret."""
    rows = _keyed(spark, sf_dir)
    text, found = frames.debug_text(F.col("v"), KEYED, standard(), "Keyed"), frames.inspect_struct(F.col("v"), KEYED, standard())
    shaped = frames.redact_columns(rows.withColumns({"text": text, "level": found["max_sensitivity"].cast("int")}), standard())
    return shaped.select("o_orderkey", F.to_json("v").alias("shaped"), F.to_json(F.col("vs")[0]).alias("item"), "text", "level")


def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type's own redaction gives way to the level of a field's name, at the top and within a structure."""
    kind = T.StructField("kind", T.StringType(), metadata={"type": "order_priority"})
    secret = T.StructField("password", T.StringType(), metadata={"type": "order_priority"})
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), kind, secret, T.StructField("who", T.StructType([kind, secret]))])
    priority = F.col("o_orderpriority")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", priority.alias("kind"), priority.alias("password"), F.struct(priority.alias("kind"), priority.alias("password")).alias("who")).to(schema)
    return frames.redact_columns(rows, standard()).select("o_orderkey", "kind", "password", F.to_json("who").alias("who"))


def shaped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON, opaque as a whole where it is over the output limit."""
    tight = standard().builder().limits(max_output_bytes=312).build()
    return table(spark, sf_dir, "orders").select("o_orderkey", frames.redact_struct_json(_order(), ORDER, tight).alias("text"))


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels without texts, of all formats, and as a report."""
    n, page = F.col("page_id") % 3, F.col("page_id")
    name = F.when(n == 0, "page").when(n == 1, "license_key").otherwise("Proxy-Authorization")
    kind = T.StructType([T.StructField("url", T.StringType()), T.StructField("more", T.MapType(T.StringType(), T.StringType()))])
    value = F.struct("url", F.create_map(name, F.lit("v")).alias("more"))
    found = {
        "field": fields.inspect_field(name, F.col("url"), standard()), "env": fields.inspect_env(name, F.col("url"), standard()), "struct": frames.inspect_struct(value, kind, standard()),
        "url": formats.inspect_http_url(F.col("url"), standard()), "body": formats.inspect_http_body(_text('{"', name, '":', page, F.when(n == 2, "").otherwise("}")), standard(), F.lit("application/json")),
        "form": formats.inspect_http_body(_text(name, "=", F.when(n == 0, "%zz").otherwise("a")), standard(), F.lit("application/x-www-form-urlencoded")),
    }
    rows = table(spark, sf_dir, "pages").select("page_id", *(c.alias(k) for k, c in found.items()))
    return rows.select("page_id", *(F.col(f"{k}.max_sensitivity").cast("int").alias(k) for k in found), F.col("body.ok").alias("body_ok"), F.col("form.reasons").alias("form_reasons"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as batches in which each turn has another format."""
    turn, conv = F.col("turn"), F.col("conv_id")
    k = (conv * 3 + turn) % 14
    ops = ["literal", "field", "env", "env_pairs", "argv", "heuristic_argv", "process", "http_headers", "json", "json_value", "uri", "http_url", "http_body", "shell"]
    value = F.coalesce(
        F.when(k == 6, "client").when(k.isin(8, 9), _text('{"token":"t","n":', turn, "}")).when(k == 10, _text("s3://u:p@bucket/", conv, "?token=t&n=", turn)).when(k == 11, _text("https://u@h.example/", conv, "?token=t#", turn))
        .when(k == 12, _text("token=t&n=", turn)), _text("say ", conv, "\t", turn),
    )
    arg = lambda v, s=None: F.struct(v.cast("string").alias("value"), F.lit(s).cast("string").alias("sensitivity"))
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.element_at(F.array(*map(F.lit, ops)), (k + 1).cast("int")).alias("op"), F.when(k == 2, "API_KEY").otherwise("password").alias("name"), value.alias("value"),
        F.array(arg(F.lit("--password")), arg(turn), arg(_text("user", conv), "low")).alias("args"), F.array(pair("N", turn), pair("DB_PASSWORD", conv)).alias("env"),
        F.array(F.struct(F.lit("X-Turn").alias("name"), turn.cast("string").alias("value"), F.lit(False).alias("sensitive")), F.struct(F.lit("Cookie").alias("name"), conv.cast("string").alias("value"), F.lit(False).alias("sensitive"))).alias("headers"),
        F.when(k == 12, "application/x-www-form-urlencoded").alias("content_type"),
    )


def batch_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation of a batch; one that is unknown shows nothing."""
    return groups.batch_items(_items(spark, sf_dir), "conv_id", "turn", standard()).select("conv_id", "turn", "text", F.col("completion").cast("int").alias("completion"), "reasons")


def composed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.compose(groups.batch_items(_items(spark, sf_dir), "conv_id", "turn", standard()), "conv_id", "turn").select("conv_id", "text", F.col("completion").cast("int").alias("completion"), "reasons")


def composed_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals and values of one row, one after another."""
    texts = (fields.redact_literal("order ", standard())["text"], F.col("o_orderkey").cast("string"), fields.redact_literal(" status\t", standard())["text"], fields.field_text("status", F.col("o_orderstatus"), STATUS))
    return table(spark, sf_dir, "orders").select("o_orderkey", groups.compose_row(*texts).alias("text"))


def resolved_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of items, of items that are missing, and of another batch."""
    talks = table(spark, sf_dir, "conversations")
    items = groups.batch_fields(talks.where("conv_id % 5 <> 0"), "conv_id", "turn", "role", F.col("role"), standard())
    return groups.resolve(items, talks.select("conv_id", (F.col("turn") + 1).alias("turn")), "conv_id", "turn").select("conv_id", "turn", "text", "error")


def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of results by conversation: worst completion, all reasons, summed usage."""
    tight = Policy(rules=rules_of({"system": SECRET, "user": HIGH}), limits=standard().limits.__class__(max_output_bytes=300))
    r = fields.redact_field("note", F.col("text"), tight)
    merged = table(spark, sf_dir, "conversations").select("role", r.alias("r")).groupBy("role").agg(*merge_summaries("r"))
    return merged.select("role", F.col("completion").cast("int").alias("completion"), "reasons", "output", "omitted")


def stored_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from partial summaries of every eight turns, of which some don't know what was left out."""
    tight = Policy(rules=rules_of({"system": SECRET, "user": HIGH}), limits=standard().limits.__class__(max_output_bytes=300))
    turn, text = F.col("turn"), F.col("text")
    body = formats.redact_http_body(text, tight, F.lit("text/plain"), source_truncated=(turn % 5 == 4) & (F.col("role") == "assistant"))
    results = table(spark, sf_dir, "conversations").select("role", (turn % 8).alias("part"), F.when(turn % 2 == 0, fields.redact_field("note", text, tight)).otherwise(body).alias("r"))
    merged = merge_partials(partial_summaries(results, ["role", "part"], "r"), ["role"])
    return merged.select("role", "n_results", F.col("completion").cast("int").alias("completion"), "reasons", "presented", "omitted")


def discovered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a JSON column whose rows have different fields, with the levels of their names."""
    turn, conv = F.col("turn"), F.col("conv_id")
    tags = F.when(turn % 3 == 1, F.array(F.struct(F.col("role").alias("name"), turn.alias("api_key")), F.struct(F.col("role").alias("name"), (turn + 1).alias("api_key"))))
    value = F.struct(F.col("role"), turn.alias("turn"), F.struct(conv.alias("session_id"), tags.alias("tags")).alias("meta"), F.when(conv % 2 == 0, F.struct(turn.alias("n"), F.array(conv).alias("ids"))).alias("credentials"))
    talks = table(spark, sf_dir, "conversations").select(F.to_json(value).alias("j"))
    return frames.discover_json(talks, "j", standard()).select("path", F.col("max_sensitivity").alias("level"))


ALL = (
    json_value, nested_urls, json_bodies, ndjson_bodies, multipart_bodies, other_bodies, debug_shapes, structure_limits, structure_limits_json, deep_structures, keyed_maps, typed_columns, shaped_json, inspections, batch_formats, composed_formats, composed_row,
    resolved_handles, merged_summaries, stored_summaries, discovered_json,
)

#: Of each order the tags, lines and deep structure of _basket, and where the limits end: 1 in the tags, 2 before a line, 3 in the third line, 4 at the deep structure's field, 5 at its depth, 0 nowhere.
BASKET = """
    WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS t, o_orderkey // 8 % 4 AS m, o_orderkey // 32 % 3 = 0 AS deep FROM orders),
    e AS (SELECT *, CASE WHEN t > 5 THEN 1 WHEN m > 5 - t THEN 2 WHEN m = 3 THEN 3 WHEN m = 2 AND deep THEN 4 WHEN deep THEN 5 ELSE 0 END AS stop FROM o),
    p AS (SELECT *, 'Basket { id: ' || o_orderkey || ', tags: [' || array_to_string(range(1, least(t, 5) + 1), ', ') AS tags,
        array_to_string(['lines { a: ' || i || ', password: "<redacted>" }' FOR i IN range(1, least(m, greatest(5 - t, 0), 2) + 1)], ', ') AS body FROM e)"""
_CHAIN = "n { n: "

ESCAPED = "replace(replace(replace({0}, chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
ITEMS = """
    WITH c AS (SELECT conv_id, turn, (conv_id * 3 + turn) % 14 AS k FROM conversations),
    t AS (SELECT conv_id, turn, k, CASE k WHEN 0 THEN 'say ' || conv_id || '\\t' || turn WHEN 1 THEN '<redacted>' WHEN 2 THEN 'API_KEY=****' WHEN 3 THEN '["N=' || turn || '", "DB_PASSWORD=<redacted>"]'
        WHEN 4 THEN '["--password", "' || turn || '", "' || CASE WHEN length('user' || conv_id) <= 4 THEN '****' ELSE left('user' || conv_id, 2) || '****' || right('user' || conv_id, 2) END || '"]'
        WHEN 5 THEN '["--password", "<redacted>", "' || left('user' || conv_id, 2) || '****' || right('user' || conv_id, 2) || '"]'
        WHEN 6 THEN '["client", "--password", "<redacted>", "' || left('user' || conv_id, 2) || '****' || right('user' || conv_id, 2) || '"]["N=' || turn || '", "DB_PASSWORD=<redacted>"]'
        WHEN 7 THEN 'cookie: [****]' || chr(10) || 'x-turn: [' || turn || ']' WHEN 8 THEN '{"token":"****","n":' || turn || '}' WHEN 9 THEN '{"token":"****","n":' || turn || '}'
        WHEN 10 THEN 's3://u:%3Credacted%3E@bucket/' || conv_id || '?token=****&n=' || turn WHEN 11 THEN 'https://****@h.example/' || conv_id || '?token=****#****' WHEN 12 THEN 'token=****&n=' || turn ELSE '<redacted>' END AS text,
        0 AS completion, CASE k WHEN 13 THEN 256 ELSE 0 END AS reasons FROM c)"""
ORDER_TEXT = f"""'Order::' || CASE WHEN o_orderkey % 2 = 0 THEN 'Even' ELSE 'Odd' END || ' {{ id: ' || o_orderkey || ', status: "****", raw: "{{\\"token\\":\\"****\\",\\"k\\":' || o_orderkey || '}}", place: Pair(' || o_custkey || ', "' || o_orderstatus
    || '"), tags: ["*******\\""], plain: [' || o_orderkey || ', ' || (o_orderkey + 1) || '], by_key: {{"a": ' || o_orderkey || ', "api_key": "****"}}, entries: {{"' || o_orderstatus || '": "****"}}, maybe: '
    || CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE 'Some(' || o_orderkey || ')' END || ', card: priority ' || left(o_orderpriority, 1) || ' }}'"""

SQL = {
    "json_value": """SELECT event_id, '{"kind":"' || event_type || '","who":{"api_key":"****","ids":[' || event_id || ',' || user_id || ']},"more":{"' || event_type || '":"m","session_id":"****"}}' AS text, 3 AS level FROM events""",
    "nested_urls": """
        SELECT page_id, 'https://outer.example/?page=' || page_id || '&next=' || CASE WHEN page_id % 3 = 2 THEN 'plain' ELSE 'https%3A%2F%2Finner.example%2Fp%3Ftoken%3D****%26n%3D' || page_id END AS text,
        CASE WHEN page_id % 3 < 2 THEN 3 END AS level FROM pages""",
    "json_bodies": """
        WITH p AS (SELECT page_id, page_id % 5 AS n, '{"id":' || page_id || ',"url":"' || url || '","refresh_token":"****"}' AS t FROM pages)
        SELECT page_id, CASE n WHEN 3 THEN '<redacted: invalid JSON>' WHEN 4 THEN '<redacted: invalid or truncated JSON><truncated>' ELSE t END AS text, CASE n WHEN 3 THEN 32 WHEN 4 THEN 48 ELSE 0 END AS reasons,
        CASE n WHEN 4 THEN 1 ELSE 0 END AS completion, CASE n WHEN 4 THEN 7 ELSE 0 END AS omitted FROM p""",
    "ndjson_bodies": """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '<redacted: invalid NDJSON>' ELSE '{"id":' || page_id || ',"token":"****"}\\n\\n{"url":"x"}\\n' END AS text FROM pages""",
    "multipart_bodies": """
        SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '<redacted: multipart body>' ELSE '<multipart>\\n id=' || page_id || '\\n session_id=****\\n file=<redacted: file part>\\n doc={"token":"****","n":' || page_id || '}\\n</multipart>' END AS text FROM pages""",
    "other_bodies": """
        SELECT page_id, CASE page_id % 5 WHEN 0 THEN '<binary ' || 2 * (page_id % 90 + 1) || ' bytes>' WHEN 1 THEN 'page\\t' || url WHEN 2 THEN '' WHEN 3 THEN '<redacted: unsupported HTTP body>' ELSE '<redacted: invalid content type body>' END AS text,
        CASE page_id % 5 WHEN 3 THEN 256 WHEN 4 THEN 128 ELSE 0 END AS reasons FROM pages""",
    "debug_shapes": f"SELECT o_orderkey, {ORDER_TEXT} AS text FROM orders",
    "structure_limits": BASKET + """
        SELECT o_orderkey, tags || CASE WHEN stop <> 1 THEN '], lines: [' || body ELSE '' END || CASE stop WHEN 0 THEN '], deep: None }' WHEN 1 THEN ', <truncated><truncated>' WHEN 2 THEN CASE WHEN body = '' THEN '' ELSE ', ' END || '<truncated><truncated>'
            WHEN 3 THEN ', lines { a: 3, ...: <truncated><truncated>' WHEN 4 THEN '], deep: deep { ...: <truncated><truncated>' ELSE '], deep: deep { x: x { z: <truncated>' END AS text,
        CASE stop WHEN 0 THEN 0 ELSE 1 END AS completion, CASE stop WHEN 0 THEN 0 WHEN 5 THEN 8 ELSE 4 END AS reasons, CASE stop WHEN 1 THEN 5 ELSE t + least(m, 5 - t) END AS n_items, stop = 0 AS ok, CASE stop WHEN 0 THEN 4 END AS level FROM p""",
    "structure_limits_json": BASKET + """
        SELECT o_orderkey, CASE WHEN stop > 0 THEN '<redacted>' ELSE '{"id":' || o_orderkey || ',"tags":[' || array_to_string(range(1, t + 1), ',') || '],"lines":[' || array_to_string(['{"a":' || i || ',"password":"<redacted>"}' FOR i IN range(1, m + 1)], ',') || ']}' END AS text FROM p""",
    "deep_structures": f"SELECT o_orderkey, '{_CHAIN * DEEPEST}' || o_orderkey || '{' }' * DEEPEST}' AS within, '{_CHAIN * DEEPEST}<truncated>' AS over FROM orders",
    "keyed_maps": """
        WITH k AS (SELECT o_orderkey, '{"by_number":{"' || (o_orderkey % 7) || '":"{\\"password\\":\\"<redacted>\\",\\"n\\":' || o_orderkey || '}"},"by_day":{"18294":"[{\\"api_key\\":\\"****\\",\\"plain\\":\\"' || o_orderstatus || '\\"}]"},"by_struct":"<redacted>"}' AS t, o_orderstatus AS s FROM orders)
        SELECT o_orderkey, t AS shaped, t AS item, 'Keyed { by_number: {"' || (o_orderkey % 7) || '": by_number { password: "<redacted>", n: ' || o_orderkey || ' }}, by_day: {"2020-02-02": [{"api_key": "****", "plain": "' || s || '"}]}, by_struct: {?: "<redacted>"} }' AS text, 4 AS level FROM k""",
    "typed_columns": """SELECT o_orderkey, 'priority ' || left(o_orderpriority, 1) AS kind, '<redacted>' AS password, '{"kind":"priority ' || left(o_orderpriority, 1) || '","password":"<redacted>"}' AS who FROM orders""",
    "shaped_json": """
        WITH s AS (SELECT o_orderkey, '{"kind":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'Even' ELSE 'Odd' END || '","id":' || o_orderkey || ',"status":"****","raw":"{\\"token\\":\\"****\\",\\"k\\":' || o_orderkey || '}","place":{"_1":' || o_custkey || ',"_2":"' || o_orderstatus
            || '"},"tags":["*******"],"plain":[' || o_orderkey || ',' || (o_orderkey + 1) || '],"by_key":{"a":"' || o_orderkey || '","api_key":"****"},"entries":{"' || o_orderstatus || '":"****"}'
            || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"maybe":' || o_orderkey END || ',"card":"priority ' || left(o_orderpriority, 1) || '"}' AS t FROM orders)
        SELECT o_orderkey, CASE WHEN strlen(t) > 312 THEN '<redacted>' ELSE t END AS text FROM s""",
    "inspections": """
        WITH p AS (SELECT page_id, page_id % 3 AS n, CASE page_id % 3 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS v, url FROM pages)
        SELECT page_id, v AS field, v AS env, v AS struct, CASE WHEN url LIKE '%#_%' THEN 3 END AS url, CASE n WHEN 1 THEN 2 END AS body, CASE WHEN n > 0 THEN v END AS form, n < 2 AS body_ok, CASE n WHEN 0 THEN 512 ELSE 0 END AS form_reasons FROM p""",
    "batch_formats": ITEMS + "SELECT conv_id, turn, text, completion, reasons FROM t",
    "composed_formats": ITEMS + "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, max(completion) AS completion, bit_or(reasons) AS reasons FROM t GROUP BY conv_id",
    "composed_row": f"SELECT o_orderkey, 'order ' || o_orderkey || ' status\\t' || {LOW_WRITTEN.format('o_orderstatus')} AS text FROM orders",
    "resolved_handles": """
        WITH h AS (SELECT conv_id, turn + 1 AS turn FROM conversations), i AS (SELECT conv_id, turn, role FROM conversations WHERE conv_id % 5 <> 0)
        SELECT h.conv_id, h.turn, role AS text, CASE WHEN h.conv_id % 5 = 0 THEN 'different_batch' WHEN role IS NULL THEN 'missing_item' END AS error FROM h LEFT JOIN i USING (conv_id, turn)""",
    "discovered_json": f"""
        WITH j AS (SELECT '{{"role":"' || role || '","turn":' || turn || ',"meta":{{"session_id":' || conv_id || CASE WHEN turn % 3 = 1 THEN ',"tags":[{{"name":"' || role || '","api_key":' || turn || '}}]' ELSE '' END || '}}'
            || CASE WHEN conv_id % 2 = 0 THEN ',"credentials":{{"n":' || turn || ',"ids":[' || conv_id || ']}}' ELSE '' END || '}}' AS j FROM conversations),
        p AS (SELECT DISTINCT regexp_replace(substr(t.fullkey, 3), '[[][0-9]+[]]', '[]', 'g') AS path FROM j, json_tree(j.j) t WHERE t.fullkey <> '$'), s AS (SELECT replace(name, '_', '') AS name, level FROM ({STANDARD_NAMES})),
        n AS (SELECT path, replace(unnest(string_split(replace(path, '[]', ''), '.')), '_', '') AS name FROM p)
        SELECT path, max(level)::INTEGER AS level FROM n LEFT JOIN s USING (name) GROUP BY path""",
    "stored_summaries": f"""
        WITH c AS (SELECT role, turn % 2 = 0 AS own, turn % 5 = 4 AND role = 'assistant' AS cut, strlen({ESCAPED.format("text")}) AS n, strlen(text) AS raw FROM conversations)
        SELECT role, count(*) AS n_results, max(CASE WHEN own AND n > 300 THEN 2 WHEN NOT own AND cut THEN 1 ELSE 0 END) AS completion, bit_or(CASE WHEN own AND n > 300 THEN 2 WHEN NOT own AND cut THEN 16 ELSE 0 END) AS reasons,
        sum(CASE WHEN own THEN 0 ELSE raw END)::BIGINT AS presented, CASE WHEN bool_or(NOT own AND cut) THEN NULL ELSE 0 END AS omitted FROM c GROUP BY role""",
    "merged_summaries": f"""
        WITH c AS (SELECT role, strlen({ESCAPED.format("text")}) AS n FROM conversations)
        SELECT role, max(CASE WHEN n > 300 THEN 2 ELSE 0 END) AS completion, bit_or(CASE WHEN n > 300 THEN 2 ELSE 0 END) AS reasons, sum(CASE WHEN n > 300 THEN 0 ELSE n END)::BIGINT AS output, 0 AS omitted FROM c GROUP BY role""",
}
