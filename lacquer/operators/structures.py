"""Structured text of any schema, and its limits, as expressions that grow with the number of fields.

A schema is compiled once into three programs over the same value: its text,
its count of nodes, items and depth, and its text in pieces with what each piece
costs. A row within the limits takes the first after a look at the second, which
reads sizes and nulls alone; only a row that is over them takes its text apart
to find the place where the budget ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from ..functions.masks import escaped, opaque, quoted, written
from ..functions.names import key_level, let
from ..functions.policy import Policy
from .annotations import declared, field_level, own_redaction, part_level
from .formats import redact_json

NONE = "None"
# What stands where a field, an item or a nested value is refused.
REFUSED = {"field": "...: <truncated><truncated>", "item": "<truncated><truncated>", "value": "<truncated>"}
NESTED = (T.StructType, T.ArrayType, T.MapType)


def is_name(kind: T.DataType) -> bool:
    """Whether keys of this type can be read as the names of fields."""
    return not isinstance(kind, (*NESTED, T.VariantType))


def is_tuple(kind: T.StructType) -> bool:
    return bool(kind.fields) and all(f.name == f"_{i}" for i, f in enumerate(kind.fields, 1))


@dataclass(frozen=True)
class Shown:
    """How a field is shown: as a constant, masked as a whole, as JSON, by a redaction of its own, or by its value."""

    field: T.StructField
    level: int
    how: str


def shown_fields(kind: T.StructType, policy: Policy) -> list[Shown]:
    out = []
    for f in kind.fields:
        wish, level = declared(f), 0 if policy.disabled else field_level(f, policy)
        if wish == "variant" or wish == "skip" and not policy.disabled:
            continue
        if level:
            how = "opaque" if level >= 3 else "masked"
        elif (wish == "json" or isinstance(f.dataType, T.VariantType)) and not policy.disabled:
            how = "json"
        elif own_redaction(f) and not policy.disabled:
            how = "own"
        else:
            how = "value"
        out.append(Shown(f, level, how))
    return out


def _part(f: T.StructField, which: str, policy: Policy) -> int:
    return 0 if policy.disabled else part_level(f, which)


# ---- the text


def text_of(value: Column, kind: T.DataType, policy: Policy, name: str = "Record", items: int = 0, entries: int = 0) -> Column:
    """The value as text, without limits; null is None. items and entries are levels of an array's elements and a map's values."""
    if isinstance(kind, T.StructType):
        parts = [_field_text(value[s.field.name], s, policy, not is_tuple(kind)) for s in shown_fields(kind, policy)]
        opening, closing = _brackets(kind)
        body = F.concat_ws(", ", *parts) if parts else F.lit("")
        return F.when(value.isNull(), NONE).otherwise(F.concat(_head(value, kind, name), F.lit(opening), body, F.lit(closing)))
    if isinstance(kind, T.ArrayType):
        one = lambda x: _masked(text_of(x, kind.elementType, policy, name), items, policy) if items else text_of(x, kind.elementType, policy, name)
        return F.when(value.isNull(), NONE).otherwise(F.concat(F.lit("["), F.array_join(F.transform(value, one), ", "), F.lit("]")))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.concat(_key_text(e["key"], kind), F.lit(": "), _entry_text(e, kind, policy, name, entries))
        return F.when(value.isNull(), NONE).otherwise(F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(value), entry), ", "), F.lit("}")))
    if isinstance(kind, T.VariantType) and not policy.disabled:
        return F.coalesce(quoted(redact_json(F.to_json(value), policy)["text"]), F.lit(NONE))
    if isinstance(kind, (T.StringType, T.DateType, T.TimestampType)):
        return F.coalesce(quoted(value.cast("string")), F.lit(NONE))
    return F.coalesce(F.to_json(value) if isinstance(kind, T.VariantType) else value.cast("string"), F.lit(NONE))


def _brackets(kind: T.StructType) -> tuple[str, str]:
    return ("(", ")") if is_tuple(kind) else (" { ", " }")


def _head(value: Column, kind: T.StructType, name: str) -> Column:
    head = F.lit(name)
    for f in kind.fields:
        if declared(f) == "variant":
            head = F.concat(F.lit(f"{name}::"), F.coalesce(value[f.name].cast("string"), F.lit(NONE)))
    return head


def _masked(text: Column, level: int, policy: Policy) -> Column:
    """The mask of a level on a rendered text, quotes included, which is quoted again."""
    if level >= 3:
        return F.lit(f'"{policy.opaque(level)}"')
    return quoted(let(text, lambda t: written(t, policy.masks[level - 1])))


def _own_text(value: Column, s: Shown, policy: Policy) -> Column:
    """A field's value by its annotations alone."""
    f = s.field
    redaction = None if policy.disabled else own_redaction(f)
    if redaction:
        own = F.coalesce(redaction(value).cast("string"), F.lit(NONE))
    else:
        own = text_of(value, f.dataType, policy, (f.metadata or {}).get("name", f.name), _part(f, "items", policy), _part(f, "entries", policy))
    return F.when(value.isNotNull(), F.concat(F.lit("Some("), own, F.lit(")"))).otherwise(NONE) if (f.metadata or {}).get("optional") else own


def _field_text(value: Column, s: Shown, policy: Policy, named: bool) -> Column:
    if s.how == "opaque":
        own = F.lit(f'"{policy.opaque(s.level)}"')
    elif s.how == "masked":
        own = _masked(_own_text(value, s, policy), s.level, policy)
    elif s.how == "json":
        own = F.coalesce(quoted(_json(value, s.field, policy)["text"]), F.lit(NONE))
    else:
        own = _own_text(value, s, policy)
    return F.concat(F.lit(f"{s.field.name}: "), own) if named else own


def _json(value: Column, f: T.StructField, policy: Policy) -> Column:
    return redact_json(F.to_json(value) if isinstance(f.dataType, T.VariantType) else value, policy)


def _key_text(key: Column, kind: T.MapType) -> Column:
    return quoted(key.cast("string")) if is_name(kind.keyType) else F.lit("?")


def _entry_text(e: Column, kind: T.MapType, policy: Policy, name: str, least: int) -> Column:
    """A map's value by its key; a key that is no name says nothing about its value, which is a secret then."""
    own = text_of(e["value"], kind.valueType, policy, name)
    if policy.disabled:
        return own
    if not is_name(kind.keyType):
        return F.lit(f'"{policy.opaque(4)}"')

    def by(level: Column) -> Column:
        def shown(t: Column) -> Column:
            hidden = F.when(level == 1, written(t, policy.masks[0])).when(level == 2, written(t, policy.masks[1])).otherwise(opaque(level, policy))
            return F.when(level == 0, t).when(level >= 3, F.concat(F.lit('"'), hidden, F.lit('"'))).otherwise(quoted(hidden))

        return let(own, shown)

    return let(F.greatest(key_level(e["key"], kind.keyType, policy), F.lit(least)), by)


# ---- what it takes


@dataclass(frozen=True)
class Count:
    """Nodes, items and depth of a value as Columns, and the most of each that its schema allows (None: no bound)."""

    nodes: Column
    items: Column
    depth: Column
    most: tuple[int | None, int | None, int]


def _int(n: int) -> Column:
    return F.lit(n).cast("int")


def _plus(*bounds: int | None) -> int | None:
    return None if None in bounds else sum(bounds)


def count_of(value: Column, kind: T.DataType, policy: Policy) -> Count:
    """A struct, an array and the elements of both: a struct or array is a node and a level of depth, a field a node, an element or entry an item."""
    zero = _int(0)
    if isinstance(kind, T.StructType):
        fields = [(s, _field_count(value[s.field.name], s, policy)) for s in shown_fields(kind, policy)]
        own = [c for _, c in fields if c]
        there = lambda c: F.when(value.isNull(), zero).otherwise(c)
        nodes, items = _int(1 + len(fields)), zero
        for c in own:
            nodes, items = nodes + c.nodes, items + c.items
        depth = F.greatest(*(c.depth for c in own), zero) + 1 if own else _int(1)
        most = (_plus(1 + len(fields), *(c.most[0] for c in own)), _plus(0, *(c.most[1] for c in own)), 1 + max((c.most[2] for c in own), default=0))
        return Count(there(nodes), there(items), there(depth), most)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        inner, values = (kind.elementType, value) if isinstance(kind, T.ArrayType) else (kind.valueType, F.map_values(value))
        own = 1 if isinstance(kind, T.ArrayType) else 0
        size = F.coalesce(F.greatest(F.size(value), zero), zero)
        if not isinstance(inner, NESTED):
            alone = F.when(value.isNull(), zero).otherwise(_int(own))
            return Count(alone, size, alone, (own, None, own))
        within = lambda which: lambda x: getattr(count_of(x, inner, policy), which)
        total = lambda which: F.aggregate(F.transform(values, within(which)), zero, lambda a, x: a + x)
        deepest = F.coalesce(F.array_max(F.transform(values, within("depth"))), zero)
        there = lambda c: F.when(value.isNull(), zero).otherwise(c)
        return Count(there(_int(own) + total("nodes")), there(size + total("items")), there(_int(own) + deepest), (None, None, own + count_of(F.lit(None).cast(inner), inner, policy).most[2]))
    return Count(zero, zero, zero, (0, 0, 0))


def _field_count(value: Column, s: Shown, policy: Policy) -> Count | None:
    """What a field takes besides its own node."""
    if s.how == "json":
        used = _json(value, s.field, policy)["usage"]
        whole = F.coalesce(used["nodes"].cast("int"), _int(0))
        return Count(whole, F.coalesce(used["items"].cast("int"), _int(0)), _int(0), (None, None, 0))
    if s.how != "value" or not isinstance(s.field.dataType, NESTED):
        return None
    return count_of(value, s.field.dataType, policy)


def may_exceed(count: Count, policy: Policy) -> bool:
    """Whether any value of the schema can be over the limits."""
    nodes, items, depth = count.most
    limits = policy.limits
    return nodes is None or items is None or nodes > limits.max_nodes or items > limits.max_items or depth > limits.max_depth


def exceeds(count: Count, policy: Policy) -> Column:
    limits = policy.limits
    return (count.nodes > limits.max_nodes) | (count.items > limits.max_items) | (count.depth > limits.max_depth)


# ---- the text in pieces


def _piece(text: Column | str, nodes: Column | int = 0, items: Column | int = 0, refused: str = "", deep: bool = False) -> Column:
    whole = lambda n: (n if isinstance(n, Column) else F.lit(n)).cast("int")
    text = text if isinstance(text, Column) else F.lit(text)
    return F.array(F.struct(text.alias("t"), whole(nodes).alias("n"), whole(items).alias("i"), F.lit(refused).alias("r"), F.lit(deep).alias("deep")))


def pieces_of(value: Column, kind: T.DataType, policy: Policy, name: str, depth: int = 1, items: int = 0, entries: int = 0) -> Column:
    """The value's text as an array of pieces with the nodes and items that each must be granted first."""
    none = _piece(NONE)
    if isinstance(kind, T.StructType):
        if depth > policy.limits.max_depth:
            return F.when(value.isNull(), none).otherwise(_piece("", refused="value", deep=True))
        opening, closing = _brackets(kind)
        parts = [_piece(F.concat(_head(value, kind, name), F.lit(opening)), 1, refused="value")]
        for k, s in enumerate(shown_fields(kind, policy)):
            parts += [_piece(", ")] if k else []
            parts.append(_field_pieces(value[s.field.name], s, policy, not is_tuple(kind), depth))
        return F.when(value.isNull(), none).otherwise(F.concat(*parts, _piece(closing)))
    if isinstance(kind, T.ArrayType):
        if depth > policy.limits.max_depth:
            return F.when(value.isNull(), none).otherwise(_piece("", refused="value", deep=True))

        def element(x: Column, k: Column) -> Column:
            comma = _piece(F.when(k > 0, ", ").otherwise(""))
            if isinstance(kind.elementType, NESTED) and not items:
                return F.concat(comma, _piece("", items=1, refused="item"), pieces_of(x, kind.elementType, policy, name, depth + 1))
            own = text_of(x, kind.elementType, policy, name)
            return F.concat(comma, _piece(_masked(own, items, policy) if items else own, items=1, refused="item"))

        return F.when(value.isNull(), none).otherwise(F.concat(_piece("[", 1, refused="value"), F.flatten(F.transform(value, element)), _piece("]")))
    if isinstance(kind, T.MapType):

        def entry(e: Column, k: Column) -> Column:
            comma, key = _piece(F.when(k > 0, ", ").otherwise("")), F.concat(_key_text(e["key"], kind), F.lit(": "))
            whole = F.concat(comma, _piece(F.concat(key, _entry_text(e, kind, policy, name, entries)), items=1, refused="field"))
            if not isinstance(kind.valueType, NESTED) or not is_name(kind.keyType) and not policy.disabled:
                return whole
            free = F.concat(comma, _piece(key, items=1, refused="field"), pieces_of(e["value"], kind.valueType, policy, name, depth))
            return free if policy.disabled else F.when(F.greatest(key_level(e["key"], kind.keyType, policy), F.lit(entries)) == 0, free).otherwise(whole)

        return F.when(value.isNull(), none).otherwise(F.concat(_piece("{"), F.flatten(F.transform(F.map_entries(value), entry)), _piece("}")))
    return _piece(text_of(value, kind, policy, name))


def _field_pieces(value: Column, s: Shown, policy: Policy, named: bool, depth: int) -> Column:
    f, refused = s.field, "field" if named else "item"
    head = f"{f.name}: " if named else ""
    if s.how == "json":
        r = _json(value, f, policy)
        return F.concat(_piece(head, 1, refused=refused), _piece(F.coalesce(quoted(r["text"]), F.lit(NONE)), F.coalesce(r["usage"]["nodes"], F.lit(0)), F.coalesce(r["usage"]["items"], F.lit(0)), "value"))
    if s.how != "value" or not isinstance(f.dataType, NESTED):
        return _piece(_field_text(value, s, policy, named), 1, refused=refused)
    inner = pieces_of(value, f.dataType, policy, (f.metadata or {}).get("name", f.name), depth + 1, _part(f, "items", policy), _part(f, "entries", policy))
    if (f.metadata or {}).get("optional"):
        inner = F.when(value.isNull(), _piece(NONE)).otherwise(F.concat(_piece("Some("), inner, _piece(")")))
    return F.concat(_piece(head, 1, refused=refused), inner)


def cut_pieces(pieces: Column, policy: Policy) -> Column:
    """struct(text, deep, nodes, items): the pieces up to the first that is refused, with what stands for it."""
    limits = policy.limits
    start = F.struct(_int(0).alias("n"), _int(0).alias("i"), _int(0).alias("k"), F.lit(True).alias("open"), F.lit("").alias("r"), F.lit(False).alias("deep"))

    def step(a: Column, p: Column) -> Column:
        granted = a["open"] & ~p["deep"] & (a["n"] + p["n"] <= limits.max_nodes) & (a["i"] + p["i"] <= limits.max_items)
        stopped = F.struct(a["n"].alias("n"), a["i"].alias("i"), a["k"].alias("k"), F.lit(False).alias("open"), F.when(a["open"], p["r"]).otherwise(a["r"]).alias("r"), F.when(a["open"], p["deep"]).otherwise(a["deep"]).alias("deep"))
        return F.when(granted, F.struct((a["n"] + p["n"]).alias("n"), (a["i"] + p["i"]).alias("i"), (a["k"] + 1).alias("k"), F.lit(True).alias("open"), a["r"].alias("r"), a["deep"].alias("deep"))).otherwise(stopped)

    def joined(ps: Column) -> Column:
        def whole(end: Column) -> Column:
            marker = F.lit("")
            for r, text in REFUSED.items():
                marker = F.when(end["r"] == r, text).otherwise(marker)
            kept = F.array_join(F.transform(F.slice(ps, F.lit(1), end["k"]), lambda p: p["t"]), "")
            return F.struct(F.concat(kept, marker).alias("text"), end["deep"].alias("deep"), end["n"].alias("nodes"), end["i"].alias("items"))

        return let(F.aggregate(ps, start, step), whole)

    return let(pieces, joined)


def _cut(value: Column, kind: T.DataType, policy: Policy, name: str) -> Column:
    return cut_pieces(pieces_of(value, kind, policy, name), policy)


def rendered_text(value: Column, kind: T.DataType, policy: Policy, name: str) -> Column:
    """The log-safe text, cut where the structural limits end."""
    text, count = let(text_of(value, kind, policy, name), escaped), count_of(value, kind, policy)
    if policy.disabled or not may_exceed(count, policy):
        return text
    return F.when(exceeds(count, policy), let(_cut(value, kind, policy, name)["text"], escaped)).otherwise(text)


def rendered(value: Column, kind: T.DataType, policy: Policy, name: str) -> Column:
    """struct(text, refused, deep, nodes, items, depth): the text, and what it took of the limits."""
    text, count = let(text_of(value, kind, policy, name), escaped), count_of(value, kind, policy)
    whole = F.struct(text.alias("text"), F.lit(False).alias("refused"), F.lit(False).alias("deep"), count.nodes.alias("nodes"), count.items.alias("items"), count.depth.alias("depth"))
    if policy.disabled or not may_exceed(count, policy):
        return whole
    depth = F.least(count.depth, _int(policy.limits.max_depth))
    cut = let(_cut(value, kind, policy, name), lambda c: F.struct(let(c["text"], escaped).alias("text"), F.lit(True).alias("refused"), c["deep"].alias("deep"), c["nodes"].alias("nodes"), c["items"].alias("items"), depth.alias("depth")))
    return F.when(exceeds(count, policy), cut).otherwise(whole)
