"""HTTP bodies that need no parser: forms, texts, bytes, and bodies of types that are not known, as Columns.

Which bodies these are is decided by plain functions of the content type and the
bytes; JSON, NDJSON, multipart bodies, bodies that were cut or are near a limit,
and content types with more than one parameter are left to the parser.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.masks import by_level
from ..functions.names import let, level_column
from ..functions.policy import Policy
from .parsers import MARKERS
from .results import BIT, inspection, result, usage

_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
_TYPE = rf"^[ \t]*+({_TOKEN}/{_TOKEN})[ \t]*+"
FORM = "application/x-www-form-urlencoded"
#: What a log-safe text shows as an escape.
_UNSAFE = r"[\x00-\x1f\x7f-\x9f\x{61c}\x{200e}\x{200f}\x{2028}-\x{202e}\x{2066}-\x{2069}]"


class Body:
    """The parts of a body that decide how it is shown."""

    def __init__(self, body: Column, content_type: Column, cut: Column, policy: Policy) -> None:
        self.policy, self.text, self.size = policy, body.cast("string"), F.octet_length(body)
        self.named = content_type.isNotNull()
        self.main = F.lower(F.regexp_extract(content_type, _TYPE, 1))
        # the parser wants the type at the very start; a parameter more, and it reads them all
        self.broken = self.named & (self.main == "")
        self.simple = F.regexp_like(content_type, F.lit(rf"{_TYPE}(?:;[ \t]*+{_TOKEN}={_TOKEN}[ \t]*+)?\z"))
        self.valid = F.is_valid_utf8(self.text)
        self.whole = ~cut & (self.size <= policy.limits.max_input_bytes)
        structured = self.main.rlike(r"^multipart/|/(?:json|[^/]*\+json)\z|^application/(?:x-)?ndjson\z")
        sniffed = self.text.rlike(r"^[ \t\n\r\f]*+[\[{]")
        self.known = (self.named & self.simple & ~structured) | (~self.named & ~sniffed)
        self.is_form, self.is_text = self.named & (self.main == FORM), self.named & self.main.startswith("text/")
        self.pairs = F.size(F.array_remove(F.split(self.text, "&", -1), ""))

    def plain(self) -> Column:
        """Whether the body can be shown without the parser."""
        limits = self.policy.limits
        mask = 3 * max(len(m.opaque.encode()) + len(m.replacement.encode()) for m in self.policy.masks) + 1
        few = (self.pairs <= min(limits.max_items, limits.max_nodes)) & (3 * self.size + mask * self.pairs <= limits.max_output_bytes)
        form = self.valid & few & ~self.text.rlike(r"%(?![0-7][0-9A-Fa-f])")
        text = F.lit(self.policy.text_body != "pass_through") | ~self.valid | ((self.size <= limits.max_output_bytes) & ~self.text.rlike(_UNSAFE))
        shown = F.when(self.is_form, form).when(self.is_text, text).otherwise(True)
        return self.whole & F.coalesce((self.size == 0) | self.broken | (self.known & shown), F.lit(False))

    def shown(self, inspecting: bool) -> Column:
        """The result of a plain body."""
        policy = self.policy
        pairs = F.transform(F.filter(F.split(self.text, "&", -1), lambda p: p != ""), self._pair)

        def form(found: Column) -> Column:
            return self._whole(F.array_join(F.transform(found, lambda p: p["text"]), "&"), 0, inspecting, F.coalesce(F.array_max(F.transform(found, lambda p: p["level"])), F.lit(0)), F.size(found))

        binary = F.concat(F.lit("<binary "), self.size.cast("string"), F.lit(" bytes>"))
        text = F.when(~self.valid, binary).otherwise(self.text if policy.text_body == "pass_through" else F.lit(MARKERS["text"]))
        rest = F.when(self.size == 0, "").when(self.broken, MARKERS["content_type"]).when(self.is_text, text).when(~self.valid, binary).otherwise(MARKERS["unsupported"])
        why = F.when(self.size == 0, 0).when(self.broken, BIT["invalid_content_type"]).when(self.is_text | ~self.valid, 0).otherwise(BIT["unsupported_content_type"])
        return F.when(self.is_form & (self.size > 0), let(pairs, form)).otherwise(let(rest, lambda t: self._whole(t, why, inspecting, F.lit(0), F.lit(0))))

    def _pair(self, pair: Column) -> Column:
        decoded = lambda c: F.url_decode(c)
        key, value = F.substring_index(pair, "=", 1), F.when(F.contains(pair, F.lit("=")), F.regexp_replace(pair, r"^[^=]*+=", "")).otherwise("")

        def shown(names: Column) -> Column:
            level = level_column(names["key"], self.policy, "body")
            return let(level, lambda n: F.struct(F.concat(F.url_encode(names["key"]), F.lit("="), F.url_encode(by_level(names["value"], n, self.policy))).alias("text"), n.alias("level")))

        return let(F.struct(decoded(key).alias("key"), decoded(value).alias("value")), shown)

    def _whole(self, text: Column, why: Column | int, inspecting: bool, level: Column, n: Column) -> Column:
        used = usage(presented=self.size, output=F.octet_length(text), nodes=n, items=n, depth=F.when(n > 0, 1).otherwise(0))
        why = why if isinstance(why, Column) else F.lit(why)
        return inspection(level, self.policy, why == 0, why, used) if inspecting else result(text, self.policy, 0, why, used)


def can_be_plain(policy: Policy) -> bool:
    """Whether any body can do without the parser under this policy: its markers must fit, and a level of depth."""
    return not policy.disabled and policy.limits.max_output_bytes >= 64 and policy.limits.max_depth >= 1
