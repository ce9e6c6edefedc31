"""Whole schemas: masked columns, structured text, and sensitivity reports.

A field's name decides its level; StructField metadata {"redact": ...} may raise
it (a level name), or ask for "json", "skip", "nested" or "variant" (the field
names the variant of its struct). {"items": level} and {"entries": level} are for
the elements of an array and the values of a map, {"optional": true} for a value
that is shown as Some(...), {"type": name} for a type with a redaction of its own.
The choices are made when the plan is built, so a high or secret column is never
read from a file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.masks import escaped, opaque, written
from ..functions.names import key_level, let, level_column
from ..functions.policy import SECRET, Policy
from .annotations import Redaction, declared, field_level, own_redaction, part_level, register_redaction as register_redaction
from .fields import CUT, bounded_text, field_text
from .formats import redact_json
from .results import BIT, COMPLETE, EXHAUSTED, TRUNCATED, inspection, result, usage
from .structures import NESTED, count_of, cut_pieces, exceeds, is_name, may_exceed, pieces_of, rendered, rendered_text


def redact_columns(df: DataFrame, policy: Policy, masks: dict[str, Redaction] | None = None) -> DataFrame:
    """All columns, sensitive ones masked to strings; nested fields keep their shape; fields marked skip are dropped.

    Null stays null except in high and secret columns, which are constants. A
    type's own redaction is for columns without a level. `masks` gives columns a
    mask of their own, a function of Column to Column, which is the caller's word
    on them and takes the place of whatever their level asks for.
    """
    out = []
    for f in df.schema.fields:
        if declared(f) == "skip" and not policy.disabled:
            continue
        own = (masks or {}).get(f.name) or (None if field_level(f, policy) else own_redaction(f))
        if own and not policy.disabled:
            out.append(own(F.col(f"`{f.name}`")).alias(f.name))
            continue
        out.append(_top(F.col(f"`{f.name}`"), f, policy).alias(f.name))
    return df.select(*out)


def _top(value: Column, field: T.StructField, policy: Policy) -> Column:
    level = field_level(field, policy)
    if policy.disabled:
        return value
    if level and not isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        if level >= 3:
            return F.lit(policy.opaque(level))
        wish = declared(field)
        if isinstance(wish, int) and wish > policy.sensitivity_for(field.name):
            return written(escaped(value.cast("string")), policy.masks[level - 1])
        return field_text(field.name, value, policy)
    if level:
        return F.when(value.isNotNull(), F.lit(policy.opaque(level)))
    return shaped(value, field.dataType, policy, json=declared(field) == "json")


def shaped(value: Column, kind: T.DataType, policy: Policy, json: bool = False) -> Column:
    """The value with its shape kept and every sensitive field and map entry as an opaque string."""
    if json:
        return redact_json(value, policy)["text"]
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            if declared(f) == "skip":
                continue
            level, inner = field_level(f, policy), value[f.name]
            if level:
                own = F.when(inner.isNotNull(), F.lit(policy.opaque(level)))
            elif redaction := own_redaction(f):
                own = redaction(inner)
            elif (items := part_level(f, "items")) and isinstance(f.dataType, T.ArrayType):
                own = _hidden_items(inner, items, policy)
            elif (entries := part_level(f, "entries")) and isinstance(f.dataType, T.MapType):
                own = _hidden_entries(inner, entries, policy)
            else:
                own = shaped(inner, f.dataType, policy, declared(f) == "json")
            parts.append(own.alias(f.name))
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: shaped(x, kind.elementType, policy))
    if isinstance(kind, T.MapType):
        if not is_name(kind.keyType):  # keys that are no names may hold anything, and say nothing about their values
            return F.when(value.isNotNull(), F.lit(policy.opaque(SECRET)))
        plain = (lambda v: F.to_json(shaped(v, kind.valueType, policy))) if isinstance(kind.valueType, NESTED) else lambda v: shaped(v, kind.valueType, policy).cast("string")
        return F.transform_values(value, lambda k, v: let(key_level(k, kind.keyType, policy), lambda n: F.when(v.isNull(), F.lit(None)).when(n == 0, plain(v)).otherwise(opaque(n, policy))))
    if isinstance(kind, T.VariantType):
        return redact_json(F.to_json(value), policy)["text"]
    return value


def _hidden_items(items: Column, level: int, policy: Policy) -> Column:
    return F.transform(items, lambda x: F.when(x.isNotNull(), F.lit(policy.opaque(level))))


def _hidden_entries(entries: Column, least: int, policy: Policy) -> Column:
    return F.transform_values(entries, lambda k, v: F.when(v.isNotNull(), opaque(F.greatest(level_column(k.cast("string"), policy), F.lit(least)), policy)))


def redact_struct_json(value: Column, kind: T.DataType, policy: Policy) -> Column:
    """The shaped value as JSON text, or all of it as a secret where it is over the output limit or the limits of nodes, items and depth."""
    most, secret = policy.limits.max_output_bytes, F.lit(policy.opaque(SECRET))
    text = let(F.to_json(shaped(value, kind, policy)), lambda t: F.when(F.octet_length(t) <= most, t).when(t.isNotNull(), secret))
    count = count_of(value, kind, policy)
    return text if policy.disabled or not may_exceed(count, policy) else F.when(value.isNotNull() & exceeds(count, policy), secret).otherwise(text)


def redact_value(value: Column, kind: T.DataType, policy: Policy, name: str = "Record") -> Column:
    """The result of a structured value: its text as in debug_text, and what it took of nodes, items and depth."""
    most = policy.limits.max_output_bytes

    def whole(r: Column) -> Column:
        over = F.octet_length(r["text"]) > most
        completion = F.when(over & F.lit(most < len(CUT)), EXHAUSTED).when(over | r["refused"], TRUNCATED).otherwise(COMPLETE)
        why = F.when(r["deep"], BIT["depth_limit_reached"]).when(r["refused"], BIT["traversal_limit_reached"]).otherwise(0) + F.when(over, BIT["output_limit_reached"]).otherwise(0)
        return let(bounded_text(r["text"], policy), lambda t: result(t, policy, completion, why, usage(output=F.octet_length(t), nodes=r["nodes"], items=r["items"], depth=r["depth"])))

    return let(rendered(value, kind, policy, name), whole)


def debug_text(value: Column, kind: T.DataType, policy: Policy, name: str = "Record") -> Column:
    """The value as structured text: Name { a: 1, b: "x" }, [1, 2], { "k": "v" }; null is None.

    Where its nodes, items or depth go over their limits it ends there with a
    marker, and over the output limit its end gives way to one.
    """
    return let(rendered_text(value, kind, policy, name), lambda t: bounded_text(t, policy))


def schema_level(kind: T.DataType, policy: Policy) -> int:
    """The highest level of any field under a type, known without reading data."""
    if isinstance(kind, T.StructType):
        return max((max(field_level(f, policy), part_level(f, "items"), part_level(f, "entries"), schema_level(f.dataType, policy)) for f in kind.fields if declared(f) != "skip"), default=0)
    if isinstance(kind, T.ArrayType):
        return schema_level(kind.elementType, policy)
    return schema_level(kind.valueType, policy) if isinstance(kind, T.MapType) else 0


def inspect_columns(df: DataFrame, policy: Policy) -> DataFrame:
    """One row per column: its name and max_sensitivity (null if none), from the schema alone."""
    rows = [(f.name, max(field_level(f, policy), schema_level(f.dataType, policy)) or None) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, max_sensitivity int")


def discover_json(df: DataFrame, column: str, policy: Policy) -> DataFrame:
    """path, kind and max_sensitivity (null if none) of everything in a JSON column: one aggregate over it, and rules applied to the paths it finds.

    Names are joined by dots, [] stands for an array's elements. A path has the
    strongest level of the names on it. Where values of one path have shapes that
    don't go together its kind is VARIANT: it may hold anything, and what is below
    it is not listed. Text that is no JSON is left out.
    """
    found = df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(column).cast("string"))).alias("kind")).first()
    # backquoted names may look like anything
    ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], (found.kind if found else None) or "VOID")
    rows: list[tuple[str, str, int | None]] = []

    def walk(kind: T.DataType, path: str, level: int) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                inner, own = f"{path}.{f.name}" if path else f.name, max(level, policy.sensitivity_for(f.name))
                rows.append((inner, f.dataType.simpleString().partition("<")[0].upper(), own or None))
                walk(f.dataType, inner, own)
        elif isinstance(kind, T.ArrayType):
            rows.append((f"{path}[]", kind.elementType.simpleString().partition("<")[0].upper(), level or None))
            walk(kind.elementType, f"{path}[]", level)

    root = T.StructType.fromDDL(f"root {ddl}")["root"].dataType
    if not isinstance(root, (T.StructType, T.ArrayType, T.NullType)):
        rows.append(("", root.simpleString().upper(), None))
    walk(root, "", 0)
    return df.sparkSession.createDataFrame(rows, "path string, kind string, max_sensitivity int")


def inspect_struct(value: Column, kind: T.DataType, policy: Policy) -> Column:
    """The inspection of a structured value: its schema's level, that of the keys of its maps, and whether it is within the limits."""
    levels = F.greatest(F.lit(schema_level(kind, policy)), *_map_levels(value, kind, policy), F.lit(0))
    count = count_of(value, kind, policy)
    used = usage(nodes=count.nodes, items=count.items, depth=count.depth)
    if policy.disabled or not may_exceed(count, policy):
        return F.when(value.isNotNull(), inspection(levels, policy, used=used))
    over, deep = exceeds(count, policy), cut_pieces(pieces_of(value, kind, policy, ""), policy)["deep"]
    why = F.when(~over, 0).when(deep, BIT["depth_limit_reached"]).otherwise(BIT["traversal_limit_reached"])
    return F.when(value.isNotNull(), inspection(levels, policy, ~over, why, used))


def _map_levels(value: Column, kind: T.DataType, policy: Policy) -> list[Column]:
    """The highest level of the keys of each map under a value, a secret for keys that are no names."""
    if isinstance(kind, T.StructType):
        return [c for f in kind.fields if declared(f) != "skip" for c in _map_levels(value[f.name], f.dataType, policy)]
    if isinstance(kind, T.ArrayType):
        return _levels_within(value, kind.elementType, policy)
    if isinstance(kind, T.MapType):
        own = F.array_max(F.transform(F.map_keys(value), lambda k: key_level(k, kind.keyType, policy))) if is_name(kind.keyType) else F.when(F.size(value) > 0, F.lit(SECRET))
        return [own, *_levels_within(F.map_values(value), kind.valueType, policy)]
    return []


def _levels_within(values: Column, kind: T.DataType, policy: Policy) -> list[Column]:
    if not _map_levels(F.lit(None).cast(kind), kind, policy):
        return []
    return [F.array_max(F.transform(values, lambda x: F.greatest(*_map_levels(x, kind, policy), F.lit(0))))]


def sensitivity_report(df: DataFrame, keys: list[str], names: dict[str, Column], policy: Policy) -> DataFrame:
    """Per group and in total (rollup of keys): rows, and for each measure the highest level and the sensitive rows.

    names maps an output name to a Column of field names that are data.
    """
    levels = {k: level_column(c, policy) for k, c in names.items()}
    own = df.select(*keys, *(v.alias(f"__{k}") for k, v in levels.items()))
    aggregates = [F.count("*").alias("n_rows")]
    for k in names:
        aggregates += [F.max(f"__{k}").alias(f"{k}_max"), F.count_if(F.col(f"__{k}") > 0).alias(f"{k}_sensitive")]
    return own.rollup(*keys).agg(*aggregates)


def rules_df(spark: SparkSession, policy: Policy) -> DataFrame:
    return spark.createDataFrame(policy.rule_rows(), "layer string, name string, level int")


def classify_names(names: DataFrame, column: str, policy: Policy) -> DataFrame:
    """The application rules' verdict on a column of names: kind, rule and match (exact or token_suffix), by a join with the rules.

    The rules' table has the policy's size: Spark sends it to every task if it is
    small, and joins by shuffling the distinct names if it is not.
    """
    from ..functions.names import candidates_column

    spark = names.sparkSession
    rows = [(n, "sensitive") for n, _ in policy.rules.sensitive if n not in policy.rules.allow_suffix] + [(n, "allowed") for n in policy.rules.allow_suffix] + [(n, "exact") for n in policy.rules.allow_exact if n not in policy.rules.allow_suffix]
    rules = spark.createDataFrame(rows, "rule string, kind string")
    distinct = names.select(F.col(column).alias("name")).distinct()
    exploded = distinct.select("name", F.posexplode(candidates_column(F.col("name"), policy.rules.by_suffix)).alias("at", "rule"))
    hits = exploded.join(rules, "rule").where("kind <> 'exact' or at = 0")
    # an exact allowance comes before a level of the same name
    order = F.struct("at", F.when(F.col("kind") == "sensitive", 1).otherwise(0))
    first = hits.groupBy("name").agg(F.min_by(F.struct("rule", "kind", "at"), order).alias("hit"))
    return distinct.join(first, "name", "left").select(
        "name",
        F.when(F.col("hit").isNull(), "unknown").when(F.col("hit.kind") == "sensitive", "sensitive").otherwise("allowed").alias("kind"),
        F.col("hit.rule").alias("rule"),
        F.when(F.col("hit.at") == 0, "exact").when(F.col("hit.at") > 0, "token_suffix").alias("match"),
    )
