"""Ordered groups of rows that share one output budget: batches of items and composed texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.masks import escaped
from ..functions.policy import SECRET, Policy
from ..functions.scratch import stored
from ..functions.ship import ship
from .fields import _field_level, argv_text, env_pairs_text, field_text, headers_text, heuristic_argv_text, pair_text, redact_process
from .formats import HIDDEN, body_text, json_text, render, uri_text, url_text
from .parsers import MARKERS, cut_back
from .results import BIT, COMPLETE, EXHAUSTED, TRUNCATED
from .scan import scanned


def batch_fields(df: DataFrame, batch: str, index: str, name: str | Column, value: Column, policy: Policy) -> DataFrame:
    """batch, index, text, completion and reasons of fields whose batch shares max_output_bytes.

    An item that doesn't fit, or that comes after an exact fill, is empty and
    exhausted, and so are all after it. Sizes are totalled by a scan, so that a
    batch of any length is spread over tasks, and what is over the budget by
    itself travels without its text. The scan's table is written when this is called.
    """
    most = policy.limits.max_output_bytes
    level = _field_level(name, policy)
    unread = F.lit(level >= 3 and not policy.disabled) if isinstance(level, int) else (level >= 3) & F.lit(not policy.disabled)
    raw = F.when(unread, 0).otherwise(F.coalesce(F.octet_length(escaped(value.cast("string"))), F.lit(0)))
    wide = replace(policy, limits=replace(policy.limits, max_output_bytes=1 << 30))
    own = df.select(F.col(batch).alias("b"), F.col(index).alias("i"), F.coalesce(field_text(name, value, wide), F.lit("")).alias("text"), raw.cast("long").alias("raw"))
    own = own.withColumn("size", F.octet_length("text").cast("long")).withColumn("one", F.lit(1).cast("long")).withColumn("text", F.when(F.col("size") <= most, F.col("text")))
    spent = _ranked(own)
    first = _first_failing(spent, (F.col("spent") >= most) | (F.greatest("raw", "size") > most - F.col("spent")))
    over = F.col("first").isNotNull() & (F.col("rank") >= F.col("first.rank"))
    out = _with(spent, first)
    return out.select(
        F.col("b").alias(batch), F.col("i").alias(index), F.when(over, "").otherwise(F.col("text")).alias("text"),
        F.when(over, EXHAUSTED).otherwise(COMPLETE).cast("tinyint").alias("completion"),
        F.when(over, BIT["output_limit_reached"]).otherwise(0).alias("reasons"),
    )


def _ranked(own: DataFrame, **more: str) -> DataFrame:
    """Rows (b, i, size, one) with their rank in the batch and what those before them spend."""
    out = scanned(own, ["b"], ["i"], {"size": "sum", "one": "sum"} | more)
    return out.withColumn("spent", F.col("size_run") - F.col("size")).withColumnRenamed("one_run", "rank").drop("size_run", "one")


def _first_failing(rows: DataFrame, fails: Column, *columns: str) -> DataFrame:
    """Of each batch with one the first row that fails: (b, first), combined before it is shuffled."""
    return rows.where(fails).groupBy("b").agg(F.min(F.struct("rank", *columns)).alias("first"))


def _with(rows: DataFrame, few: DataFrame) -> DataFrame:
    """rows with the columns of a table of one row per batch; rows of a large batch are dealt out by Spark's skew join. A null batch is one too."""
    own = few.withColumnRenamed("b", "key")
    return rows.join(own, F.col("b").eqNullSafe(F.col("key")), "left").drop("key")


#: Formats whose text depends on the budget that is left.
HOW = {"json": json_text, "json_value": json_text, "uri": uri_text, "http_url": url_text, "http_body": body_text}
LISTS = ("argv", "heuristic_argv", "env_pairs", "process")


def prepared(df: DataFrame, policy: Policy, op: str, name: str, value: str) -> list[Column]:
    """op, value and content_type of the formats that are parsed; of all others the text they have without a budget, and the bytes that must fit for it.

    Arguments, pairs and headers are in columns args (value, sensitivity), env
    (name, value) and headers (name, value, sensitive); where df has no such
    column, their items are empty lists.
    """
    kind = F.col(op)
    wide = replace(policy, limits=replace(policy.limits, max_output_bytes=1 << 30))
    n, v = F.col(name).cast("string"), F.coalesce(F.col(value).cast("string"), F.lit(""))

    def lists(column: str, shape: str) -> Column:
        return F.coalesce(F.col(column).cast(shape), F.array().cast(shape)) if column in df.columns else F.array().cast(shape)

    args = lists("args", "array<struct<value:binary,sensitivity:string>>")
    env = lists("env", "array<struct<name:binary,value:binary>>")
    headers = lists("headers", "array<struct<name:string,value:binary,sensitive:boolean>>")
    level = F.lit(0) if policy.disabled else F.coalesce(_field_level(n, policy), F.lit(0))
    field = F.coalesce(field_text(n, v, wide), escaped(v))
    texts = {
        "literal": escaped(v), "field": field, "env": pair_text(F.coalesce(n, F.lit("")), v, policy), "env_pairs": env_pairs_text(env, policy), "argv": argv_text(args, policy),
        "heuristic_argv": heuristic_argv_text(args, policy), "process": redact_process(v, args, env, wide)["text"], "http_headers": headers_text(headers, policy),
    }
    shown = F.lit(None).cast("string")
    for k, text in texts.items():
        shown = F.when(kind == k, text).otherwise(shown)
    raw = F.when((kind == "field") & (level < 3), F.octet_length(escaped(v))).otherwise(0).cast("long")
    content_type = F.col("content_type").cast("string") if "content_type" in df.columns else F.lit(None).cast("string")
    # names of their own: a name that df has too would be taken for these columns inside lambdas
    return [kind.alias("__op"), F.when(kind.isin(list(HOW)), v).alias("__value"), content_type.alias("__content_type"), shown.alias("__shown"), raw.alias("__raw")]


def one_item(policy: Policy, item: tuple, left: int) -> tuple[str, int, int]:
    """Text, completion and reasons of a prepared item with `left` bytes of output."""
    op, value, content_type, shown, raw = item
    if op in HOW:
        own = replace(policy, limits=replace(policy.limits, max_output_bytes=left))
        r = render(own, body_text, value.encode(), content_type, False) if op == "http_body" else render(own, HOW[op], value)
        return r.text, r.completion, r.reasons & ~HIDDEN
    reasons = 0
    if shown is None:  # no format of ours: nothing of it may be seen
        shown, reasons = policy.opaque(SECRET), BIT["unsupported_content_type"]
    if max(raw, len(shown.encode())) <= left:
        return shown, COMPLETE, reasons
    if op == "http_headers":
        text, _, none = cut_back(shown, left, False)
    else:
        text = MARKERS["cut"] if op in LISTS and len(MARKERS["cut"]) <= left else ""
        none = not text
    return text, EXHAUSTED if none else TRUNCATED, reasons | BIT["output_limit_reached"]


def spend(policy: Policy, item: tuple, left: int) -> tuple[str, int, int, int]:
    """one_item, and the budget left for the next: 0 once an item did not fit."""
    if left <= 0:
        return "", EXHAUSTED, BIT["output_limit_reached"], 0
    text, completion, reasons = one_item(policy, item, left)
    if completion == EXHAUSTED:
        return "", EXHAUSTED, reasons, 0
    return text, completion, reasons, left - len(text.encode())


BATCH = "text string, completion tinyint, reasons int"


def batch_items(df: DataFrame, batch: str, index: str, policy: Policy, op: str = "op", name: str = "name", value: str = "value") -> DataFrame:
    """batch, index, text, completion and reasons of items of any format, in order, under one budget per batch.

    An item's op is literal, field, env, env_pairs, argv, heuristic_argv,
    process, http_headers, json, json_value, uri, http_url or http_body; any
    other is shown as a secret.

    Every item is rendered where it lies, with the whole budget, and sizes are
    totalled by a scan; up to the first item of a batch that doesn't fit into
    what is left these are the results. From there on items depend on what those
    before them left: each text takes a byte at least, so that no more texts of a
    batch than its budget has bytes meet in a task to be rendered one after
    another (and, passing by, values that a mask empties). So a batch of any
    length runs in many tasks. Tables of the
    scan are written when this is called.
    """
    spark = df.sparkSession
    ship(spark)
    most = policy.limits.max_output_bytes
    own = df.select(F.col(batch).alias("b"), F.col(index).alias("i"), *prepared(df, policy, op, name, value))
    kinds = [T.StructField(c, own.schema[c].dataType) for c in ("b", "i", "__op", "__value", "__content_type", "__shown", "__raw")]
    kept, names = len(kinds), ["text", "completion", "reasons", "size", "alone", "one", "counts", "takes"]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every item with the whole budget to itself."""
        for part in batches:
            out = []
            for item in zip(*(part.column(k).to_pylist() for k in range(2, kept)), strict=True):
                text, completion, reasons = one_item(policy, item, most)
                limited = completion == EXHAUSTED or bool(reasons & BIT["output_limit_reached"])
                size = len(text.encode())
                out.append((text, completion, reasons, size, limited, 1, limited or max(size, item[4]) > 0, int(limited or size > 0)))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            own_kinds = (pa.string(), pa.int8(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(columns, own_kinds, strict=True))], [*(f.name for f in kinds), *names])

    schema = T.StructType([*kinds, *(T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.ByteType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.LongType(), T.BooleanType(), T.LongType()), strict=True))])
    spent = _ranked(own.mapInArrow(alone, schema), takes="sum")
    fails = F.col("alone") | (F.col("spent") >= most) | (F.greatest("__raw", "size") > most - F.col("spent"))
    first = stored(_first_failing(spent, fails, "spent", "takes_run"), "first")
    rows = _with(spent, first)
    after = F.col("first").isNotNull() & (F.col("rank") >= F.col("first.rank"))
    near = F.col("counts") & (F.col("takes_run") <= F.col("first.takes_run") + most)
    contested = rows.where(after & near)

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = object(), 0
        for part in batches:
            out = []
            for b, _, rank, before, *item in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if b != last:
                    last, left = b, most - before
                text, completion, reasons, left = spend(policy, tuple(item), left)
                out.append((b, rank, text, completion, reasons, left <= 0))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = (part.schema.field(0).type, pa.int64(), pa.string(), pa.int8(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], ["b", "rank", "text", "completion", "reasons", "spent"])

    turn = contested.select("b", "i", "rank", F.col("first.spent").alias("before"), "__op", "__value", "__content_type", "__shown", "__raw")
    fields = T.StructType([kinds[0], T.StructField("rank", T.LongType()), *schema.fields[kept : kept + 3], T.StructField("spent", T.BooleanType())])
    done = stored(turn.repartition("b").sortWithinPartitions("b", "rank").mapInArrow(in_turn, fields), "turns")
    ends = done.where("spent").groupBy("b").agg(F.min("rank").alias("end"))
    rest = rows.where(~after).select("b", "i", "text", "completion", "reasons")
    late = _with(rows.where(after & ~near), ends)
    gone = (F.col("first.spent") >= most) | F.coalesce(F.col("rank") > F.col("end"), F.lit(False))
    late = late.select("b", "i", F.when(gone, "").otherwise(F.col("text")).alias("text"), F.when(gone, EXHAUSTED).otherwise(F.col("completion")).cast("tinyint").alias("completion"), F.when(gone, BIT["output_limit_reached"]).otherwise(F.col("reasons")).alias("reasons"))
    turns = contested.select("b", "i", "rank").join(done.withColumnRenamed("b", "key").drop("spent"), F.col("b").eqNullSafe(F.col("key")) & (contested["rank"] == done["rank"])).select("b", "i", "text", "completion", "reasons")
    return rest.unionByName(late).unionByName(turns).withColumnsRenamed({"b": batch, "i": index})


def compose(items: DataFrame, batch: str, index: str) -> DataFrame:
    """One row per batch: the texts of its items in order, the worst completion and all reasons. Its text is bounded by the budget that the items had, and empty items are not collected."""
    texts = F.filter(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(index, "text")))), lambda p: p.isNotNull())
    parts = items.groupBy(batch).agg(texts.alias("parts"), F.max("completion").alias("completion"), F.bit_or("reasons").alias("reasons"))
    return parts.select(batch, F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), "completion", "reasons")


def compose_row(*texts: Column) -> Column:
    """The texts of one row, one after another."""
    return F.concat(*(F.coalesce(t, F.lit("")) for t in texts))


def resolve(items: DataFrame, handles: DataFrame, batch: str, index: str) -> DataFrame:
    """The items that handles (batch, index) name, with `error` where there is none: missing_item, or different_batch for an unknown batch."""
    known = items.select(batch).distinct().withColumn("__known", F.lit(True))
    joined = handles.select(batch, index).join(items.withColumn("__hit", F.lit(True)), [batch, index], "left").join(known, batch, "left")
    error = F.when(F.col("__hit"), F.lit(None)).when(F.col("__known"), F.lit("missing_item")).otherwise(F.lit("different_batch"))
    return joined.withColumn("error", error.cast("string")).drop("__hit", "__known")
