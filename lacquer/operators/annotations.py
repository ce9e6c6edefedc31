"""What a field's name and StructField metadata say about it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, types as T

from ..functions.policy import LEVELS, Policy

#: Redactions of user types: a value's Column to that of its text.
Redaction = Callable[[Column], Column]
_types: dict[str, Redaction] = {}


def register_redaction(name: str, redaction: Redaction) -> None:
    """Fields with metadata {"type": name} are shown as this function's Column from now on, in plans built after it, unless they have a level."""
    _types[name] = redaction


def own_redaction(field: T.StructField) -> Redaction | None:
    return _types.get((field.metadata or {}).get("type", ""))


def part_level(field: T.StructField, which: str) -> int:
    """The level declared for the items or entries of a field."""
    return LEVELS.get((field.metadata or {}).get(which, ""), 0)


def declared(field: T.StructField) -> int | str:
    """The metadata's wish: a level number, 'json', 'skip', 'nested' or ''."""
    wish = (field.metadata or {}).get("redact", "")
    return LEVELS.get(wish, wish)


def field_level(field: T.StructField, policy: Policy) -> int:
    wish = declared(field)
    return max(wish if isinstance(wish, int) else 0, policy.sensitivity_for(field.name))
