"""JSON, URI, HTTP URL and HTTP body redaction: Arrow-batched functions around the parsers.

The guards are inside the functions, because Spark may evaluate them on rows
that a surrounding condition skips. A null text gives a null result. Whatever
can't be parsed is replaced, never shown, and never fails the job.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, functions as F

from ..functions.policy import SECRET, Policy
from ..functions.ship import ship
from . import parsers as P
from .bodies import Body, can_be_plain
from .results import BIT, COMPLETE, EXHAUSTED, INSPECTION, RESULT, TRUNCATED

#: text, names of reasons; of a value cut to the input limit, and what the walk saw.
Render = Callable[..., tuple[str, tuple[str, ...]]]


class Rendered(NamedTuple):
    """One value as the fields of a result struct, flat, with its level."""

    text: str
    completion: int
    reasons: int
    presented: int
    inspected: int
    output: int
    nodes: int
    items: int
    depth: int
    omitted: int | None
    level: int


NOTHING = Rendered("", COMPLETE, 0, 0, 0, 0, 0, 0, 0, 0, 0)


def render(policy: Policy, how: Render, data: str | bytes, *more, missing: int | None = 0) -> Rendered:
    """One value. JSON that is too large is replaced as a whole; of URIs, URLs and bodies a first part stays, with a marker."""
    limits, seen = policy.limits, P.Seen(policy)
    raw = data.encode("utf-8", "replace") if isinstance(data, str) else data
    size = len(raw)
    kept = raw[: limits.max_input_bytes]
    cut = size > len(kept)
    reasons = {"input_limit_reached"} if cut else set()
    given = kept.decode("utf-8", "ignore") if isinstance(data, str) else kept
    whole = how is json_text
    try:
        text, why = how(given, seen, cut, *more)
        reasons |= set(why)
    except P.LimitReached as e:
        text, whole = P.MARKERS["cut"], True
        reasons.add(e.reason)
    except RecursionError:
        text, whole = P.MARKERS["cut"], True
        reasons.add("depth_limit_reached")
    # bodies say at their end that the source went on
    gone = how is body_text and bool(text) and (cut or "source_truncated" in reasons)
    if whole:
        text = P.log_safe(text)
        if len(text.encode("utf-8", "replace")) > limits.max_output_bytes:
            reasons.add("output_limit_reached")
            text = P.MARKERS["cut"] if len(P.MARKERS["cut"]) <= limits.max_output_bytes else ""
            completion = TRUNCATED if text else EXHAUSTED
        else:
            completion = TRUNCATED if reasons & INCOMPLETE else COMPLETE
    else:
        text, short, none = P.cut_back(text, limits.max_output_bytes, gone)
        if short and not gone or none:
            reasons.add("output_limit_reached")
        completion = EXHAUSTED if none else TRUNCATED if short or reasons & INCOMPLETE else COMPLETE
    omitted = None if missing is None else size - len(kept) + missing
    return Rendered(text, completion, P.mask_bits(tuple(reasons)), size, len(kept), len(text.encode("utf-8", "replace")), seen.nodes, seen.items, seen.depth, omitted, seen.level)


#: Reasons that leave something out.
INCOMPLETE = {"input_limit_reached", "output_limit_reached", "traversal_limit_reached", "depth_limit_reached", "source_truncated"}


def json_text(text: str, seen: P.Seen, cut: bool) -> tuple[str, tuple[str, ...]]:
    policy = seen.policy
    if policy.disabled:
        return text, ()
    try:
        return P.dump_json(P.redact_tree(P.parse_json(text), seen, None, policy.opaque(SECRET))), ()
    except ValueError:
        return policy.opaque(SECRET), ("invalid_json",)


def uri_text(text: str, seen: P.Seen, cut: bool) -> tuple[str, tuple[str, ...]]:
    shown = P.redact_uri(text, seen)
    return (P.MARKERS["uri"], ("invalid_uri",)) if shown is None else (shown, ())


def url_text(text: str, seen: P.Seen, cut: bool) -> tuple[str, tuple[str, ...]]:
    url = P.parse_url(text)
    return (P.MARKERS["url"], ("invalid_uri",)) if url is None else (P.redact_url(url, seen), ())


def body_text(body: bytes, seen: P.Seen, cut: bool, kind: str | None, source_cut: bool) -> tuple[str, tuple[str, ...]]:
    text, why = P.redact_body(body, kind, cut or source_cut, seen)
    # rendering does not report broken forms and multipart bodies; inspection does
    return text, (*why, *(("source_truncated",) if source_cut else ()))


HIDDEN = BIT["invalid_form"] | BIT["invalid_multipart"]


USED = pa.struct([*((n, pa.int64()) for n in ("presented", "inspected", "output", "nodes", "items")), ("depth", pa.int32()), ("omitted", pa.int64())])


def _column(rows: list[Rendered], name: str, kind: pa.DataType) -> pa.Array:
    return pa.array([getattr(r, name) for r in rows], kind)


def _structs(rows: list[Rendered], policy: Policy, inspecting: bool) -> pa.Array:
    n = len(rows)
    used = pa.StructArray.from_arrays([_column(rows, f.name, f.type) for f in USED], fields=list(USED))
    disabled = pa.array([policy.disabled] * n, pa.bool_())
    if inspecting:
        ok = [r.completion == COMPLETE and not r.reasons for r in rows]
        level = pa.array([r.level or None if good else None for r, good in zip(rows, ok, strict=True)], pa.int8())
        return pa.StructArray.from_arrays([pa.array(ok, pa.bool_()), level, disabled, _column(rows, "reasons", pa.int32()), used], ["ok", "max_sensitivity", "disabled", "reasons", "usage"])
    shown = pa.array([r.reasons & ~HIDDEN for r in rows], pa.int32())
    return pa.StructArray.from_arrays([_column(rows, "text", pa.string()), _column(rows, "completion", pa.int8()), shown, disabled, used], ["text", "completion", "reasons", "disabled", "usage"])


def _udf(policy: Policy, how: Render, inspecting: bool):
    """An Arrow function of one column, or of a body's four: bytes, content type, whether the source went on, its length."""
    ship()
    kind = INSPECTION if inspecting else RESULT

    def missing(size: int, cut: bool, total: int | None) -> int | None:
        return (max(0, total - size) if total is not None else None) if cut else 0

    if how is body_text:

        @F.arrow_udf(kind)
        def four(body: pa.Array, content_type: pa.Array, cut: pa.Array, total: pa.Array) -> pa.Array:
            rows = [
                NOTHING if b is None else render(policy, how, b, k, bool(c), missing=missing(len(b), bool(c), t))
                for b, k, c, t in zip(body.to_pylist(), content_type.to_pylist(), cut.to_pylist(), total.to_pylist(), strict=True)
            ]
            return _structs(rows, policy, inspecting)

        return four

    @F.arrow_udf(kind)
    def one(values: pa.Array) -> pa.Array:
        # each distinct text of a batch is parsed once; a null's result is not looked at
        distinct = values.dictionary_encode()
        return _structs([render(policy, how, v) for v in distinct.dictionary.to_pylist()], policy, inspecting).take(distinct.indices)

    return one


def _apply(policy: Policy, how: Render, inspecting: bool, *columns: Column) -> Column:
    return F.when(columns[0].isNotNull(), _udf(policy, how, inspecting)(*columns))


def redact_json(text: Column, policy: Policy) -> Column:
    """Compact JSON with sensitive keys masked; numbers keep their spelling. Text that is no JSON is replaced."""
    return _apply(policy, json_text, False, text.cast("string"))


def inspect_json(text: Column, policy: Policy) -> Column:
    return _apply(policy, json_text, True, text.cast("string"))


def redact_json_value(value: Column, policy: Policy) -> Column:
    """redact_json of a struct, array, map or variant."""
    return redact_json(F.to_json(value), policy)


def inspect_json_value(value: Column, policy: Policy) -> Column:
    return inspect_json(F.to_json(value), policy)


def redact_uri(text: Column, policy: Policy) -> Column:
    return _apply(policy, uri_text, False, text.cast("string"))


def inspect_uri(text: Column, policy: Policy) -> Column:
    return _apply(policy, uri_text, True, text.cast("string"))


def redact_http_url(text: Column, policy: Policy) -> Column:
    return _apply(policy, url_text, False, text.cast("string"))


def inspect_http_url(text: Column, policy: Policy) -> Column:
    return _apply(policy, url_text, True, text.cast("string"))


def _body(body: Column, content_type: Column | None, source_truncated: Column | None, total_len: Column | None) -> tuple[Column, ...]:
    kind = F.lit(None).cast("string") if content_type is None else content_type.cast("string")
    total = F.lit(None).cast("bigint") if total_len is None else total_len.cast("bigint")
    cut = F.lit(False) if source_truncated is None else F.coalesce(source_truncated, F.lit(False))
    if total_len is not None:
        cut = cut | F.coalesce(total > F.octet_length(body.cast("binary")), F.lit(False))
    return body.cast("binary"), kind, cut, total


def _http_body(inspecting: bool, policy: Policy, body: Column, kind: Column, cut: Column, total: Column) -> Column:
    """Forms, texts, bytes and unknown types as Columns, the rest by the parser."""
    if not can_be_plain(policy):
        return _apply(policy, body_text, inspecting, body, kind, cut, total)
    own = Body(body, kind, cut, policy)
    plain = own.plain()
    return F.when(plain, own.shown(inspecting)).otherwise(_apply(policy, body_text, inspecting, F.when(~plain, body), kind, cut, total))


def redact_http_body(body: Column, policy: Policy, content_type: Column | None = None, source_truncated: Column | None = None, total_len: Column | None = None) -> Column:
    """A body by its content type; without one, JSON is recognised by its first character.

    Of a captured prefix, total_len says how long the source was; it makes usage.omitted known.
    """
    return _http_body(False, policy, *_body(body, content_type, source_truncated, total_len))


def inspect_http_body(body: Column, policy: Policy, content_type: Column | None = None, source_truncated: Column | None = None, total_len: Column | None = None) -> Column:
    return _http_body(True, policy, *_body(body, content_type, source_truncated, total_len))
