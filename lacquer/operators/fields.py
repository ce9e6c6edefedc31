"""Named scalars, environment pairs, argument lists and processes as Column expressions.

A null value gives a null result. Values that are not valid UTF-8 come as
binary columns; they are replaced as secret.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from ..functions.masks import by_level, enclosed, escaped, masked, opaque, printed, utf8_start, written
from ..functions.names import let, level_column, levels_column
from ..functions.policy import SECRET, Policy
from ..functions.ship import ship
from .results import BIT, COMPLETE, EXHAUSTED, TRUNCATED, inspection, result, usage

CUT = "<truncated>"


def redact_field(name: str | Column, value: Column, policy: Policy) -> Column:
    """The value of a named field. With the name known when the plan is built, a high or secret value is never read."""
    level = _field_level(name, policy)
    if isinstance(level, int) and (level < 3 or policy.disabled):

        def whole(raw: Column) -> Column:
            over = F.octet_length(raw) > policy.limits.max_output_bytes
            return result(_plain_field(raw, level, policy), policy, F.when(over, EXHAUSTED).otherwise(COMPLETE), F.when(over, BIT["output_limit_reached"]).otherwise(0))

        return let(escaped(value.cast("string")), whole)
    return result(field_text(name, value, policy), policy, *_field_status(name, value, policy))


def _plain_field(raw: Column, level: int, policy: Policy) -> Column:
    """The log-safe text of a field of a known level below high, empty if it or its mask is over the output limit."""
    most = policy.limits.max_output_bytes
    text = raw if not level or policy.disabled else written(raw, policy.masks[level - 1])
    return F.when((F.octet_length(raw) <= most) & (F.octet_length(text) <= most), text).when(raw.isNotNull(), F.lit(""))


def _field_level(name: str | Column, policy: Policy) -> int | Column:
    return policy.sensitivity_for(name) if isinstance(name, str) else level_column(name, policy)


def field_text(name: str | Column, value: Column, policy: Policy) -> Column:
    """The text of redact_field: opaque for high and secret, masked for low and medium, else as it is; always log-safe."""
    level, most = _field_level(name, policy), policy.limits.max_output_bytes
    if isinstance(level, int):
        if level >= 3 and not policy.disabled:
            return F.lit(policy.opaque(level)) if len(policy.opaque(level).encode()) <= most else F.lit("")
        return let(escaped(value.cast("string")), lambda raw: _plain_field(raw, level, policy))
    raw = escaped(value.cast("string"))
    if policy.disabled:
        return F.when(F.octet_length(raw) <= most, raw).when(value.isNotNull(), F.lit(""))

    def shown(own: Column) -> Column:
        text = F.when(own >= 3, F.when(value.isNotNull(), opaque(own, policy))).otherwise(let(raw, lambda r: F.when(F.octet_length(r) <= most, by_level(r, own, policy, empty_too=True))))
        return let(text, lambda t: F.when(F.octet_length(t) <= most, t).when(value.isNotNull(), F.lit("")))

    return let(level, shown)


def _field_status(name: str | Column, value: Column, policy: Policy) -> tuple[Column | int, Column | int]:
    level, most = _field_level(name, policy), policy.limits.max_output_bytes
    if isinstance(level, int) and level >= 3 and not policy.disabled:
        over = len(policy.opaque(level).encode()) > most
        return (EXHAUSTED, BIT["output_limit_reached"]) if over else (COMPLETE, 0)
    seen = F.octet_length(escaped(value.cast("string"))) > most
    if not isinstance(level, int) and not policy.disabled:
        seen = seen & (level < 3)
    return F.when(seen, EXHAUSTED).otherwise(COMPLETE), F.when(seen, BIT["output_limit_reached"]).otherwise(0)


def inspect_field(name: str | Column, value: Column, policy: Policy) -> Column:
    level = _field_level(name, policy)
    size = F.octet_length(value.cast("string"))
    over = size > policy.limits.max_input_bytes
    used = usage(presented=size)
    out = inspection(F.lit(level) if isinstance(level, int) else level, policy, ~over, F.when(over, BIT["input_limit_reached"]).otherwise(0), used)
    return F.when(value.isNotNull(), out)


def _text(value: Column) -> Column:
    """A string, or null where bytes are not UTF-8; strings pass."""
    return F.try_validate_utf8(value.cast("string"))


def pair_text(name: Column, value: Column, policy: Policy, level: Column | None = None) -> Column:
    """NAME=value, both log-safe; a side that is not UTF-8 makes the value secret."""
    n, v = _text(name), _text(value)
    value_text = let(level_column(n, policy) if level is None else level, lambda own: let(by_level(v, own, policy), escaped))
    shown = F.when(n.isNull() | v.isNull(), F.lit(policy.opaque(SECRET))).otherwise(value_text)
    return F.when(name.isNotNull() & value.isNotNull(), F.concat(escaped(F.make_valid_utf8(name.cast("string"))), F.lit("="), shown))


def _bounded(text: Column, policy: Policy, too_much: Column | None = None, size: Column | None = None) -> Column:
    """The text, or <truncated> if it is over the output limit or its input over the input limits. All three are computed once."""
    too_much = F.lit(False) if too_much is None else F.coalesce(too_much, F.lit(False))
    size = F.lit(0) if size is None else F.coalesce(size, F.lit(0))
    return let(F.struct(text.alias("text"), too_much.alias("too_much"), size.alias("size")), lambda x: _judged(x["text"], policy, x["too_much"], x["size"]))


def _judged(text: Column, policy: Policy, too_much: Column, size: Column) -> Column:
    limits = policy.limits
    over = F.octet_length(text) > limits.max_output_bytes
    heavy = size > limits.max_input_bytes
    reasons = F.when(over, BIT["output_limit_reached"]).otherwise(0) + F.when(too_much, BIT["traversal_limit_reached"]).otherwise(0) + F.when(heavy, BIT["input_limit_reached"]).otherwise(0)
    bad = over | too_much | heavy
    shown = F.when(text.isNull(), F.lit(None)).when(bad, F.lit(CUT if len(CUT) <= limits.max_output_bytes else "")).otherwise(text)
    return result(shown, policy, F.when(bad, TRUNCATED).otherwise(COMPLETE), reasons, usage(presented=size, inspected=F.when(heavy, 0).otherwise(size), output=F.octet_length(shown)))


def bounded_text(text: Column, policy: Policy) -> Column:
    """The log-safe text, or, over the output limit, what of its start leaves room for the marker; no character or escape is cut in two."""
    most = policy.limits.max_output_bytes
    if most < len(CUT):
        return F.when(F.octet_length(text) <= most, text).when(text.isNotNull(), F.lit(""))
    whole = F.regexp_replace(utf8_start(text, most - len(CUT)), r"\\(u(\{[0-9a-f]*)?)?$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(whole, F.lit(CUT)))


def redact_env(name: Column, value: Column, policy: Policy) -> Column:
    return _bounded(pair_text(name, value, policy), policy, size=F.octet_length(name.cast("string")) + F.octet_length(value.cast("string")))


def _total(items: Column, size) -> Column:
    return F.aggregate(items, F.lit(0), lambda s, x: s + F.coalesce(size(x), F.lit(0)))


def _pair_levels(pairs: Column, policy: Policy) -> Column:
    """The level of each pair's name; 0 where that is no text."""
    return levels_column(F.transform(pairs, lambda p: _text(p["name"])), policy)


def env_pairs_text(pairs: Column, policy: Policy) -> Column:
    """["A=x", "B=y"] of an array of name and value structs, in order and with repetitions."""
    return _list(F.zip_with(pairs, _pair_levels(pairs, policy), lambda p, level: F.coalesce(pair_text(p["name"], p["value"], policy, level), F.lit(""))))


def redact_env_pairs(pairs: Column, policy: Policy) -> Column:
    size = _total(pairs, lambda p: F.octet_length(p["name"].cast("string")) + F.octet_length(p["value"].cast("string")))
    return _bounded(env_pairs_text(pairs, policy), policy, F.size(pairs) > policy.limits.max_items, size)


def inspect_env_pairs(pairs: Column, policy: Policy) -> Column:
    level = F.array_max(F.zip_with(pairs, _pair_levels(pairs, policy), lambda p, own: F.when(_text(p["name"]).isNull() | _text(p["value"]).isNull(), F.lit(SECRET)).otherwise(own)))
    over = F.size(pairs) > policy.limits.max_items
    return F.when(pairs.isNotNull(), inspection(F.coalesce(level, F.lit(0)), policy, ~over, F.when(over, BIT["traversal_limit_reached"]).otherwise(0)))


def inspect_env(name: Column, value: Column, policy: Policy) -> Column:
    return inspect_env_pairs(F.array(F.struct(name.alias("name"), value.alias("value"))), policy)


def _tagged(item: Column, policy: Policy) -> Column:
    """An item with an explicit level (a level number or name), masked; opaque if it is not UTF-8."""
    level = _level_number(item["sensitivity"])
    return F.when(_text(item["value"]).isNull(), F.lit(policy.opaque(SECRET))).otherwise(by_level(_text(item["value"]), level, policy))


def _level_number(level: Column) -> Column:
    low = F.lower(level.cast("string"))
    return F.coalesce(F.when(low == "low", 1).when(low == "medium", 2).when(low == "high", 3).when(low == "secret", 4), low.try_cast("int"))


def _list(texts: Column) -> Column:
    return let(F.concat(F.lit("["), F.array_join(F.transform(texts, enclosed), ", "), F.lit("]")), printed)


def argv_text(items: Column, policy: Policy) -> Column:
    """A quoted list in which only items tagged by the caller are masked."""
    return _list(F.transform(items, lambda i: F.when(i["sensitivity"].isNotNull(), _tagged(i, policy)).otherwise(F.make_valid_utf8(i["value"].cast("string")))))


def redact_argv(items: Column, policy: Policy) -> Column:
    """An array of structs of value and sensitivity (a level, or null)."""
    return _bounded(argv_text(items, policy), policy, F.size(items) > policy.limits.max_items, _total(items, lambda i: F.octet_length(i["value"].cast("string"))))


#: Stands for a level that the next item is masked with unread.
UNREAD = 5


def _taken_apart(raw: bytes | None, policy: Policy) -> tuple[str | None, bool, bool, str, str, int]:
    """An item's text (None if it is not UTF-8), whether it is an assignment or an option, what stands before a masked value, that value, and the level of the name that decides."""
    try:
        v = raw.decode() if raw is not None else None
    except UnicodeDecodeError:
        v = None
    if v is None:
        return None, False, False, "", "", 0
    left, equals, right = v.partition("=")
    assigned, double, bare = bool(equals), v.startswith("--"), left.lstrip("-")
    option = not assigned and v.startswith("-") and bare != ""
    if assigned and not double:
        name = left[2:] if v.startswith("-D") else "" if v.startswith("-") else left
    else:
        name = bare
    # a word that is neither option nor assignment has no name
    level = policy.sensitivity_for(name if assigned or option else "", exact=option and not double)
    return v, assigned, option, left, right, level


#: How an item stands in its list: after one that masks it with a level up to UNREAD, or tagged by the caller with a level or (UNREAD) an unknown one.
TAGGED, STATES = UNREAD + 1, 2 * (UNREAD + 1)


def _shown(part: tuple[str | None, bool, bool, str, str, int], state: int, policy: Policy) -> tuple[str | None, int]:
    """Text, in quotes, and level of an item in a state; of an unknown tag there is no text."""
    v, assigned, _, left, right, level = part
    if state >= TAGGED:
        mine = state - TAGGED
    else:
        mine = SECRET if v is None or state == UNREAD else state or (level if assigned else 0)
    if v is None or state == UNREAD:
        text = policy.opaque(SECRET)
    elif assigned and state == 0 and level:
        text = f"{left}={policy.mask(level, right)}"
    elif mine == UNREAD:
        return None, 0
    else:
        text = policy.mask(mine, v) if mine else v
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"', mine


def _scan(items: Column, policy: Policy) -> Column:
    """struct(text, plain, level, n, size): a quoted list, whether it is printable ASCII, its strongest level, its items and their bytes, by a scan from left to right in which a sensitive option masks the item after it.

    Unprinted characters are left as they are, for _scanned_text. The state between items is the level
    that the next item is masked with; UNREAD stands for one that is masked unread.
    It depends on the item before alone, so that a batch is scanned by arrays, and
    each distinct item of a batch is taken apart, and shown in each state, once.
    """
    ship()

    @F.arrow_udf("struct<text:string,plain:boolean,level:int,n:int,size:bigint>")
    def scan(lists: pa.Array) -> pa.Array:
        values, tags, tagged = lists.flatten().flatten()
        distinct = values.dictionary_encode()
        parts = [_taken_apart(x, policy) for x in [*distinct.dictionary.to_pylist(), None]]
        item = pc.fill_null(distinct.indices, len(parts) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        tag, has_tag = pc.fill_null(tags, -1).to_numpy(zero_copy_only=False), tagged.to_numpy(zero_copy_only=False).astype(bool)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        some = sizes > 0
        heads = (ends - sizes)[some]

        after = np.array([UNREAD if v is None else level if option else 0 for v, _, option, _, _, level in parts])[item]
        after[has_tag] = 0
        before = np.zeros_like(item)
        before[1:] = after[:-1]
        before[heads] = 0
        state = np.where(has_tag, TAGGED + np.where((tag >= 0) & (tag <= SECRET), tag, UNREAD), before)

        ways = pa.array(item * STATES + state).dictionary_encode()
        shown = [_shown(parts[k // STATES], k % STATES, policy) for k in ways.dictionary.to_pylist()]
        way = ways.indices.to_numpy(zero_copy_only=False)
        odd = np.array([text is not None and not (text.isascii() and text.isprintable()) for text, _ in shown], bool)[way]
        has_text = np.array([text is not None for text, _ in shown], bool)[way]
        edges = np.r_[0, ends]
        offsets = np.r_[0, np.cumsum(has_text)][edges].astype(np.int32)
        texts = pa.array([text for text, _ in shown], pa.string()).take(pa.array(way[has_text]))
        text = pc.binary_join_element_wise("[", pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), texts), ", "), "]", "")

        level = np.zeros(len(sizes), np.int32)
        if len(heads):
            level[some] = np.maximum.reduceat(np.where(has_tag, np.maximum(tag, 0), np.array([own for _, own in shown])[way]), heads)
        lengths = np.r_[pc.binary_length(distinct.dictionary).to_numpy(zero_copy_only=False), 0]
        size = np.diff(np.r_[0, np.cumsum(lengths[item], dtype=np.int64)][edges])
        plain = np.diff(np.r_[0, np.cumsum(odd)][edges]) == 0
        return pa.StructArray.from_arrays([text, *map(pa.array, (plain, level, sizes, size))], ["text", "plain", "level", "n", "size"], mask=lists.is_null())

    def passed(item: Column) -> Column:
        has_tag = item["sensitivity"].isNotNull()
        return F.struct(item["value"].cast("binary").alias("value"), F.when(has_tag, _level_number(item["sensitivity"])).alias("tag"), has_tag.alias("tagged"))

    return scan(F.transform(items, passed))


def _scanned_text(scanned: Column) -> Column:
    """The list that _scan gives, with unprinted characters escaped."""
    return F.when(scanned["plain"], scanned["text"]).otherwise(printed(scanned["text"]))


def heuristic_argv_text(items: Column, policy: Policy) -> Column:
    return _scanned_text(_scan(items, policy))


def redact_heuristic_argv(items: Column, policy: Policy) -> Column:
    """redact_argv, with assignments, options and JVM properties of sensitive names masked as well."""
    scanned = _scan(items, policy)
    return _bounded(_scanned_text(scanned), policy, scanned["n"] > policy.limits.max_items, scanned["size"])


def inspect_argv(items: Column, policy: Policy, heuristic: bool = False) -> Column:
    if heuristic:
        scanned = _scan(items, policy)
        level, n = scanned["level"], scanned["n"]
    else:
        level, n = F.array_max(F.transform(items, lambda i: F.coalesce(_level_number(i["sensitivity"]), F.lit(0)))), F.size(items)
    over = n > policy.limits.max_items
    return F.when(items.isNotNull(), inspection(F.coalesce(level, F.lit(0)), policy, ~over, F.when(over, BIT["traversal_limit_reached"]).otherwise(0)))


def _command(program: Column, args: Column) -> Column:
    first = F.struct(program.cast("binary").alias("value"), F.lit(None).cast("string").alias("sensitivity"))
    return F.concat(F.array(first), F.transform(args, lambda a: F.struct(a["value"].cast("binary").alias("value"), a["sensitivity"].cast("string").alias("sensitivity"))))


def redact_process(program: Column, args: Column, env: Column, policy: Policy) -> Column:
    """A heuristic argument list of program and args, followed by the environment list; empty if they hold too many items."""
    items = _command(program, args)
    scanned = _scan(items, policy)
    text = F.concat(_scanned_text(scanned), env_pairs_text(env, policy))
    size = scanned["size"] + _total(env, lambda p: F.octet_length(p["name"].cast("string")) + F.octet_length(p["value"].cast("string")))
    # the budget of items is one for the whole process
    many = scanned["n"] + F.size(env) > policy.limits.max_items

    def whole(x: Column) -> Column:
        over = (F.octet_length(x["text"]) > policy.limits.max_output_bytes) & ~x["many"]
        shown = F.when(x["many"], F.lit("")).when(over, F.lit(CUT)).otherwise(x["text"])
        reasons = F.when(x["many"], BIT["traversal_limit_reached"]).when(over, BIT["output_limit_reached"]).otherwise(0)
        return result(shown, policy, F.when(x["many"] | over, TRUNCATED).otherwise(COMPLETE), reasons, usage(presented=x["size"], output=F.octet_length(shown)))

    return let(F.struct(text.alias("text"), many.alias("many"), size.alias("size")), whole)


def inspect_process(program: Column, args: Column, env: Column, policy: Policy) -> Column:
    a, e = inspect_argv(_command(program, args), policy, heuristic=True), inspect_env_pairs(env, policy)
    level = F.greatest(F.coalesce(a["max_sensitivity"], F.lit(0)), F.coalesce(e["max_sensitivity"], F.lit(0)))
    many = F.size(args) + 1 + F.size(env) > policy.limits.max_items
    return inspection(level, policy, a["ok"] & e["ok"] & ~many, F.when(many, BIT["traversal_limit_reached"]).otherwise(0))


def headers_text(headers: Column, policy: Policy) -> Column:
    """name: [v1, v2] lines by lower-case name from an array of name, value and sensitive structs."""
    low = lambda h: F.lower(h["name"].cast("string"))
    names = F.array_sort(F.array_distinct(F.transform(headers, low)))

    def value(h: Column) -> Column:
        v = _text(h["value"])
        shown = F.when(v.isNotNull() & v.rlike(r"^[\t -~]*$"), v).otherwise(F.lit("<non-utf8>"))
        level = F.when(F.coalesce(h["sensitive"], F.lit(False)), F.lit(SECRET)).otherwise(level_column(low(h), policy, "header"))
        return let(level, lambda own: by_level(shown, own, policy))

    line = lambda n: F.concat(n, F.lit(": ["), F.array_join(F.transform(F.filter(headers, lambda h: low(h) == n), value), ", "), F.lit("]"))
    return escaped_lines(F.transform(names, line))


def escaped_lines(lines: Column) -> Column:
    return F.array_join(F.transform(lines, escaped), "\n")


def redact_http_headers(headers: Column, policy: Policy) -> Column:
    """Lines by name; over the output limit their end gives way to a marker."""
    size = _total(headers, lambda h: F.octet_length(h["name"].cast("string")) + F.octet_length(h["value"].cast("string")))
    text = headers_text(headers, policy)
    # a list whose input is too large is replaced as a whole
    over = F.octet_length(text) > policy.limits.max_output_bytes
    plain = _bounded(F.when(over, F.lit("")).otherwise(text), policy, F.size(headers) > policy.limits.max_items, size)
    shown = bounded_text(text, policy)
    cut = result(shown, policy, F.when(shown == "", EXHAUSTED).otherwise(TRUNCATED), BIT["output_limit_reached"], usage(presented=size, output=F.octet_length(shown)))
    return F.when(over & (plain["completion"] == COMPLETE), cut).otherwise(plain)


def inspect_http_headers(headers: Column, policy: Policy) -> Column:
    level = F.array_max(F.transform(headers, lambda h: F.when(F.coalesce(h["sensitive"], F.lit(False)), F.lit(SECRET)).otherwise(level_column(F.lower(h["name"].cast("string")), policy, "header"))))
    over = F.size(headers) > policy.limits.max_items
    return F.when(headers.isNotNull(), inspection(F.coalesce(level, F.lit(0)), policy, ~over, F.when(over, BIT["traversal_limit_reached"]).otherwise(0)))


def redact_literal(text: str, policy: Policy) -> Column:
    return result(escaped(F.lit(text)), policy)


def mask_value(value: Column, level: int, policy: Policy) -> Column:
    """The value masked by the policy's mask of a level; empty stays empty."""
    return masked(value, policy.masks[level - 1])
