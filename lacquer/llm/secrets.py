"""Secret scans in DataFrame functions only: credential patterns and windowed entropy.

Positions come from the text between matches (split) and the matches
themselves (regexp_extract_all), so no Python runs. The entropy of a sliding
window is kept up by the change that one leaving and one entering character
make to the sum of c * log2(c) over the window's character counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import let

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of 24 hex digits or an AKIA run of 20 is what the longest match of the unlimited patterns leaves.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{%d,}"


@dataclass(frozen=True)
class EntropyRules:
    """Window length, bits a character needs per class, and candidates that are never reported."""

    window: int = 20
    hex_bits: float = 3.0
    upper_bits: float = 3.4
    mixed_bits: float = 3.7
    allowed: tuple[str, ...] = field(
        default=(
            r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUIDs name things
            r"(?i)example|sample|placeholder|xxxx",
            r"^sha(1|256|384|512)-",  # integrity hashes of public files
            r"^[0-9/_+=-]*[A-Za-z]{1,3}[0-9/_+=-]*$",  # dates, versions and sizes
        )
    )


def running(values: Column, start: int, merge: Callable[[Column, Column], Column]) -> Column:
    """merge of each value with all before it. Within parts of 64 values, then over the parts, so that no long array grows element by element."""

    def within(part: Column, first: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = merge(acc.now, x).cast("int")
            return F.struct(now.alias("now"), F.concat(acc.out, F.array(now)).alias("out"))

        return F.aggregate(part, F.struct(first.cast("int").alias("now"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc.out)

    def over(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int")), lambda k: F.slice(v, k * 64 + 1, F.lit(64)))
        return let(parts, lambda p: F.flatten(F.transform(F.arrays_zip(p.alias("part"), starts(p).alias("before")), lambda x: within(x.part, x.before))))

    def starts(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, F.lit(start), lambda x, y: merge(x, y).cast("int")))
        return F.slice(F.concat(F.array(F.lit(start)), within(whole, F.lit(start))), F.lit(1), F.size(parts))

    # what a lambda uses is computed again for each element unless it is a variable
    return let(values, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(F.array().cast("array<int>")))


def located(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Spans of all matches, leftmost and non-overlapping, in code points; `keep` is an array of flags beside the matches."""
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = KINDS.index(kind)
    # every match but the text after the last one
    sizes = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit")), lambda x: F.length(x.gap) + F.length(x.hit))
    ends = running(sizes, 0, lambda x, y: x + y)
    span = lambda x: F.struct((x.end - F.length(x.hit)).cast("int").alias("start"), F.lit(rank).alias("rank"), x.end.cast("int").alias("end"), F.lit(kind).alias("kind"))
    spans = F.transform(F.arrays_zip(found.alias("hit"), ends.alias("end")), span)
    if keep is None:
        return spans
    return F.transform(F.filter(F.arrays_zip(spans.alias("span"), keep.alias("keep")), lambda x: x.keep), lambda x: x.span)


def base_spans(text: Column) -> Column:
    """Spans of the three credential patterns by start and kind. Cheap tests skip the patterns where they can't match."""
    empty = F.array().cast(SPAN)
    low = F.lower(text)
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("api"))
    long = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    return F.array_sort(
        F.concat(
            F.when(named, located(text, ASSIGN, "assign", long)).otherwise(empty),
            F.when(F.contains(text, F.lit("AKIA")), located(text, ACCESS, "access")).otherwise(empty),
            F.when(text.rlike(HEX), located(text, HEX, "hex")).otherwise(empty),
        )
    )


def windows(candidate: Column, bits: Column, w: int) -> Column:
    """First start and last end of the windows whose entropy reaches `bits`, and the highest entropy; first is -1 if there are none.

    The counts of the window's characters are kept in a map, which a step
    changes by the character that leaves and the one that enters.
    """
    return let(F.split(candidate, ""), lambda every: _windows(every, bits, w))


def _windows(every: Column, bits: Column, w: int) -> Column:
    share = lambda c: c * F.when(c > 0, F.log2(F.greatest(c, F.lit(1.0)))).otherwise(0.0)
    opening = F.slice(every, F.lit(1), F.lit(w))
    counts = let(opening, lambda o: F.map_from_arrays(F.array_distinct(o), F.transform(F.array_distinct(o), lambda c: F.size(F.filter(o, lambda x: x == c)).cast("double"))))
    total = F.aggregate(F.map_values(counts), F.lit(0.0), lambda s, c: s + share(c))
    moves = F.transform(F.slice(every, F.lit(w + 1), F.greatest(F.size(every) - w, F.lit(0))), lambda c, i: F.struct(F.get(every, i).alias("gone"), c.alias("come")))
    entropy = lambda s: F.lit(math.log2(w)) - s / w
    begin = F.struct(
        counts.alias("counts"), total.alias("sum"), F.lit(0).alias("at"), F.when(entropy(total) >= bits, 0).otherwise(-1).alias("first"),
        F.when(entropy(total) >= bits, w).otherwise(-1).alias("last"), entropy(total).alias("best"),
    )

    def step(acc: Column, x: Column) -> Column:
        same = x.gone == x.come
        gone, come = acc.counts[x.gone], F.coalesce(acc.counts[x.come], F.lit(0.0))
        s = F.when(same, acc["sum"]).otherwise(acc["sum"] - share(gone) + share(gone - 1) - share(come) + share(come + 1))
        change = F.when(same, F.create_map(x.gone, F.lit(0.0))).otherwise(F.map_from_arrays(F.array(x.gone, x.come), F.array(F.lit(-1.0), F.lit(1.0))))
        now = F.map_zip_with(acc.counts, change, lambda _, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
        hit = entropy(s) >= bits
        return F.struct(
            now.alias("counts"), s.alias("sum"), (acc.at + 1).alias("at"), F.when(hit & (acc["first"] < 0), acc.at + 1).otherwise(acc["first"]).alias("first"),
            F.when(hit, acc.at + 1 + w).otherwise(acc["last"]).alias("last"), F.greatest(acc.best, entropy(s)).alias("best"),
        )

    return F.aggregate(moves, begin, step)


def entropy_spans(text: Column, rules: EntropyRules) -> Column:
    """Spans of the high-entropy windows of candidate strings that no allow-list pattern names."""
    pattern = CANDIDATE % rules.window
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = located(text, pattern, "entropy")

    def judged(x: Column) -> Column:
        bits = F.when(x.hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), rules.hex_bits).when(x.hit.rlike("^[A-Z0-9+/_=-]+$"), rules.upper_bits).otherwise(rules.mixed_bits)
        w = windows(x.hit, bits, rules.window)
        return F.struct(x.hit.alias("hit"), x.span.alias("span"), w.alias("w"))

    allowed = lambda x: F.lit(False) if not rules.allowed else F.exists(F.array(*(F.lit(a) for a in rules.allowed)), lambda a: F.regexp_like(x.hit, a))
    kept = F.filter(F.arrays_zip(found.alias("hit"), spans.alias("span")), lambda x: ~allowed(x))
    scored = F.filter(F.transform(kept, judged), lambda x: x.w["first"] >= 0)
    out = F.transform(scored, lambda x: F.struct((x.span.start + x.w["first"]).cast("int").alias("start"), F.lit(3).alias("rank"), (x.span.start + x.w["last"]).cast("int").alias("end"), F.lit("entropy").alias("kind")))
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def scan(documents: DataFrame, rules: EntropyRules | None = None) -> DataFrame:
    """doc_id with `base` and `spans`: arrays of start, rank, end and kind by start. Null and empty texts have none; every row is reported by itself, repeated or without id."""
    rules = rules or EntropyRules()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = documents.select("doc_id", text.alias("text"))
    got = own.select("doc_id", base_spans(F.col("text")).alias("base"), entropy_spans(F.col("text"), rules).alias("added"))
    # an added span inside a base one is none: in the order of starts, base spans first, it ends by the furthest end so far
    every = F.array_sort(F.concat("base", "added"))
    furthest = running(F.transform(every, lambda x: F.when(x.rank < 3, x.end).otherwise(0)), 0, lambda x, y: F.greatest(x, y))
    fresh = F.filter(F.arrays_zip(every.alias("span"), furthest.alias("upto")), lambda x: (x.span.rank < 3) | (x.span.end > x.upto))
    spans = F.when(F.size("added") > 0, F.transform(fresh, lambda x: x.span)).otherwise(F.col("base"))
    return got.select("doc_id", "base", spans.alias("spans"))


def report(documents: DataFrame, rules: EntropyRules | None = None) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda s: s.rank == k)).cast("long")
    return scan(documents, rules).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
