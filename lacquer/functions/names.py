"""Field names: canonical form, token-suffix candidates and resolution, in Python and as Columns."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from .ship import ship

if TYPE_CHECKING:
    from .policy import Policy, Rules

#: Unicode's white space, spelt out because regular expressions of Python and Java differ about it.
BLANKS = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEPARATORS = re.compile(rf"[_\-.\[\]{BLANKS}]+")
#: A token starts at an upper-case letter after a lower-case letter or digit, or before a lower-case one in a run of upper-case letters.
CAMEL = r"(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"


def lowered(text: str) -> str:
    """Lower case letter by letter: a sigma at the end of a word is like any other."""
    return text.replace("Σ", "σ").lower()


def canonical(name: str) -> str:
    return lowered(_SEPARATORS.sub("", name))


def _tokens(part: str) -> list[str]:
    cut = [0]
    for i in range(1, len(part)):
        a, b, c = part[i - 1], part[i], part[i + 1 : i + 2]
        if b.isupper() and (a.islower() or unicodedata.category(a)[0] == "N" or a.isupper() and c.islower()):
            cut.append(i)
    return [part[i:j] for i, j in zip(cut, [*cut[1:], len(part)], strict=True)]


@lru_cache(65_536)
def candidates(name: str, by_suffix: bool = True) -> tuple[str, ...]:
    """The canonical name, then, by suffix, what is left from each later token on."""
    tokens = [t for part in _SEPARATORS.split(name) if part for t in _tokens(part)]
    if not tokens:
        return ()
    return tuple(lowered("".join(tokens[i:])) for i in range(len(tokens) if by_suffix else 1))


def lowered_column(text: Column) -> Column:
    return F.lower(F.translate(text, "Σ", "σ"))


def canonical_column(name: Column) -> Column:
    return lowered_column(F.regexp_replace(name, rf"[_\-.\[\]{BLANKS}]", ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also inside lambdas, where Spark shares no common expressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def candidates_column(name: Column, by_suffix: bool = True) -> Column:
    parts = F.filter(F.split(name, rf"[_\-.\[\]{BLANKS}]+"), lambda p: p != "")
    split = F.flatten(F.transform(parts, lambda p: F.filter(F.split(p, CAMEL), lambda t: t != "")))

    def suffixes(tokens: Column) -> Column:
        last = F.size(tokens) if by_suffix else F.least(F.size(tokens), F.lit(1))
        every = F.transform(F.sequence(F.lit(1), last), lambda i: lowered_column(F.array_join(F.slice(tokens, i, F.size(tokens)), "")))
        return F.when(F.size(tokens) > 0, every).otherwise(F.array().cast("array<string>"))

    return let(split, suffixes)


#: Names that a literal of a set of names holds about; larger sets are dealt out by hash.
LITERAL = 100
#: Names of a larger set's share, which is searched from its start.
SHARE = 8


def among(names: list[str]) -> Callable[[Column], Column]:
    """Whether a canonical name is one of a set of any size: a search in one literal, of the set or of the name's share of it.

    A line break ends each name, and no canonical name has one. So an expression
    has as many parts for a hundred thousand names as for ten.
    """
    n = 1 if len(names) <= LITERAL else -(-len(names) // SHARE)
    line = lambda c: F.concat(F.lit("\n"), c, F.lit("\n"))
    if n <= 1:
        return lambda c: F.contains(F.lit("\n" + "\n".join(names) + "\n"), line(c))
    shares: list[list[str]] = [[] for _ in range(n)]
    for name in names:
        shares[zlib.crc32(name.encode()) % n].append(name)
    # one literal: Catalyst splits it once, when it folds constants
    table = F.split(F.lit("\r".join("\n" + "\n".join(x) + "\n" for x in shares)), "\r", -1)
    return lambda c: F.contains(F.get(table, (F.crc32(c.cast("binary")) % n).cast("int")), line(c))


def rules_level(names: Column, rules: Rules, floor: bool) -> Column:
    """0 to 4 for an array of candidates, by Rules.level."""
    strongest = F.lit(rules.unknown)
    for level in sorted({v for _, v in rules.sensitive}):
        strongest = F.when(F.exists(names, among([n for n, v in rules.sensitive if v == level])), F.lit(level)).otherwise(strongest)
    if floor or not (rules.allow_exact or rules.allow_suffix):
        return strongest
    # the first candidate that has any rule decides whether the field is allowed
    known = [*(n for n, _ in rules.sensitive), *rules.allow_suffix]
    allowed = among(list(rules.allow_exact))(F.get(names, F.lit(0))) if rules.allow_exact else F.lit(False)
    if rules.allow_suffix:
        allowed = allowed | among(list(rules.allow_suffix))(F.get(F.filter(names, among(known)), F.lit(0)))
    return F.when(F.coalesce(allowed, F.lit(False)), F.lit(0)).otherwise(strongest)


def level_column(name: Column, policy: Policy, context: str | None = None, exact: Column | None = None) -> Column:
    """The level of a name that is data: 0 passes, 4 is secret; a null name has level 0. Where `exact` is true only the whole name counts."""
    layers = [(policy.rules, False), (policy.floor, True)]
    if context:
        own = getattr(policy, context)
        layers += [(own.rules, False), (own.floor, True)]
    layers = [(r, floor) for r, floor in layers if r is not None and (r.sensitive or r.unknown)]
    if not layers:
        return F.lit(0)

    def strongest(names: Column) -> Column:
        first = F.slice(names, 1, 1)
        parts = [rules_level(names if r.by_suffix else first, r, floor) for r, floor in layers]
        return F.coalesce(F.greatest(*parts, F.lit(0)), F.lit(0)).cast("int")

    every = candidates_column(name)
    if exact is not None:
        every = let(every, lambda names: F.when(exact, F.slice(names, 1, 1)).otherwise(names))
    return let(every, strongest)


def key_level(key: Column, kind: T.DataType, policy: Policy) -> Column:
    """The level of a map's key. Integers and days have no letters: where no rule has such a name they pass, and are not looked up."""
    layers = [r for r in (policy.rules, policy.floor) if r is not None]
    if isinstance(kind, (T.IntegralType, T.DateType)) and not any(r.unknown or any(re.fullmatch(r"[0-9+]*", n) for n, _ in r.sensitive) for r in layers):
        return F.lit(0)
    return level_column(key.cast("string"), policy)


def levels_column(names: Column, policy: Policy, context: str | None = None) -> Column:
    """The levels of an array of names that are data, as by level_column; a null name has level 0. Each distinct name of a batch is looked up once.

    An Arrow function, which lambdas can't hold: there level_column serves.
    """
    ship()

    @F.arrow_udf("array<int>")
    def levels(lists: pa.Array) -> pa.Array:
        distinct = lists.flatten().dictionary_encode()
        own = pa.array([policy.sensitivity_for(n, context) for n in distinct.dictionary.to_pylist()], pa.int32())
        found = pc.fill_null(own.take(distinct.indices), 0)
        offsets = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), found, mask=lists.is_null())

    return levels(names)
