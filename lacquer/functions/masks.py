"""Masks, log-safe escaping and quoting as Column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .names import let
from .policy import Mask, Policy

#: Control characters, bidirectional marks, and line and paragraph separators.
UNSAFE = r"[\p{Cc}\x{61c}\x{200e}\x{200f}\x{2028}-\x{202e}\x{2066}-\x{2069}]"
#: What a quoted string shows as an escape besides the above: characters that are not printed, and combining marks.
UNPRINTED = r"[\p{C}\p{Zl}\p{Zp}\p{Mn}\p{Me}[\p{Zs}&&[^ ]]]"


def written(value: Column, mask: Mask) -> Column:
    """The masked value; an empty one is masked too."""
    if mask.kind in ("fixed", "empty"):
        return F.when(value.isNotNull(), F.lit(mask.opaque))
    kept = F.concat(F.left(value, F.lit(mask.prefix)), F.lit(mask.replacement), F.right(value, F.lit(mask.suffix)))
    return F.when(F.length(value) <= max(mask.full, mask.prefix + mask.suffix), F.lit(mask.replacement)).otherwise(kept)


def masked(value: Column, mask: Mask) -> Column:
    """The masked value; an empty one stays empty and null stays null."""
    return F.when(value == "", F.lit("")).otherwise(written(value, mask))


def utf8_start(text: Column, most: Column | int) -> Column:
    """The first `most` bytes of a text less the part of a character at their end. A text that is no UTF-8 is made valid first."""
    most = most if isinstance(most, Column) else F.lit(most)
    starts = [F.substring(text.cast("binary"), F.lit(1), F.greatest(most - k, F.lit(0))).cast("string") for k in range(4)]
    whole = [F.when(F.is_valid_utf8(s), s) for s in starts]
    return F.coalesce(*whole, F.make_valid_utf8(starts[0]))


def bounded(text: Column, most: Column | int) -> Column:
    """struct(text, truncated): the text cut at a character boundary to `most` bytes of UTF-8."""
    most = most if isinstance(most, Column) else F.lit(most)
    over = F.octet_length(text) > most
    return F.struct(F.when(over, utf8_start(text, most)).otherwise(text).alias("text"), over.alias("truncated"))


def by_level(value: Column, level: Column, policy: Policy, empty_too: bool = False) -> Column:
    """The value masked by a level that is data; level 0 passes it."""
    one = written if empty_too else masked
    out = F.when(level == 0, value)
    for k, m in enumerate(policy.masks, 1):
        out = out.when(level == k, one(value, m))
    return out


def opaque(level: Column, policy: Policy) -> Column:
    out = F.when(level == 1, F.lit(policy.opaque(1)))
    for k in (2, 3, 4):
        out = out.when(level == k, F.lit(policy.opaque(k)))
    return out


def _escaped_char(c: Column) -> Column:
    short = F.when(c == "\n", F.lit("\\n")).when(c == "\r", F.lit("\\r")).when(c == "\t", F.lit("\\t")).when(c == "\0", F.lit("\\0"))
    return short.otherwise(F.concat(F.lit("\\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}")))


def escaped(value: Column) -> Column:
    """Text safe for one log line: unsafe characters as \\n, \\r, \\t, \\0 or \\u{hex}; backslashes and quotes stay."""
    short = value
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        short = F.replace(short, F.lit(char), F.lit(shown))

    # only what is rare goes character by character
    def rest(text: Column) -> Column:
        return F.when(text.rlike(UNSAFE), F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(UNSAFE), _escaped_char(c)).otherwise(c)), "")).otherwise(text)

    return let(short, rest)


def enclosed(value: Column) -> Column:
    """Text in double quotes with backslashes and quotes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def printed(text: Column) -> Column:
    """Text with unprinted characters escaped, each by itself, so that a whole list can be shown at once."""
    chars = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(UNPRINTED), _escaped_char(c)).otherwise(c))
    return F.when(text.rlike(UNPRINTED), F.array_join(chars, "")).otherwise(text)


def quoted(value: Column) -> Column:
    """Text in double quotes with backslashes, quotes and unprinted characters escaped."""
    return let(enclosed(value), printed)
