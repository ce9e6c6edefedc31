"""Immutable redaction policies: leveled field rules, a floor, masks, limits and format contexts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property, lru_cache

from .names import canonical, candidates

LOW, MEDIUM, HIGH, SECRET = 1, 2, 3, 4
LEVELS = {"low": LOW, "medium": MEDIUM, "high": HIGH, "secret": SECRET}

# The names of each preset with their levels.
PRESETS: dict[str, dict[str, int]] = {
    "credentials": {
        "password": SECRET, "password_confirmation": SECRET, "passwd": SECRET, "passphrase": SECRET, "pgpassword": SECRET,
        "secret": SECRET, "client_secret": SECRET, "credential": SECRET, "credentials": SECRET, "private_key": SECRET,
        "privatekey": SECRET, "security_key": SECRET, "secret_key": SECRET, "secret_access_key": SECRET,
        "access_key": HIGH, "accesskey": HIGH, "access_key_id": MEDIUM,
    },
    "credential_containers": {
        "dsn": SECRET, "database_dsn": SECRET, "redis_url": SECRET, "mongodb_uri": SECRET, "mongodb_url": SECRET, "amqp_url": SECRET,
        "broker_url": SECRET, "http_proxy": SECRET, "https_proxy": SECRET, "all_proxy": SECRET, "docker_auth_config": SECRET,
    },
    "auth_tokens": {
        "api_key": HIGH, "apikey": HIGH, "x_api_key": HIGH, "token": HIGH, "access_token": HIGH, "refresh_token": HIGH,
        "id_token": HIGH, "jwt": HIGH, "jwt_token": HIGH, "auth_token": HIGH, "bearer": HIGH,
    },
    "http": {"authorization": HIGH, "proxy_authorization": HIGH, "cookie": HIGH, "set_cookie": HIGH},
    "session": {"session": HIGH, "session_id": HIGH, "session_token": HIGH},
    "standard_extras": {
        "auth_app_token": HIGH, "auth_user_token": HIGH, "license_key": MEDIUM, "connection_string": SECRET, "database_uri": SECRET,
        "database_url": SECRET, "mysql_pwd": SECRET, "rediscli_auth": SECRET, "sig": SECRET, "signature": SECRET,
    },
}


class PolicyError(ValueError):
    """An empty field name or replacement, or a limit out of range, and the part of the policy it is in."""

    def __init__(self, what: str, where: str = "rules"):
        super().__init__(f"{what} in {where}")
        self.what, self.where = what, where


@dataclass(frozen=True)
class Mask:
    """One of fixed, edges, suffix and empty; lengths are in code points."""

    kind: str = "fixed"
    replacement: str = "****"
    prefix: int = 0
    suffix: int = 0
    full: int = 0

    @classmethod
    def fixed(cls, replacement: str) -> Mask:
        return cls("fixed", replacement)

    @classmethod
    def preserve_edges(cls, prefix: int, suffix: int, replacement: str, full: int) -> Mask:
        return cls("edges", replacement, prefix, suffix, full)

    @classmethod
    def preserve_suffix(cls, suffix: int, replacement: str, full: int) -> Mask:
        return cls("suffix", replacement, 0, suffix, full)

    @classmethod
    def empty(cls) -> Mask:
        return cls("empty", "")

    @property
    def opaque(self) -> str:
        return "" if self.kind == "empty" else self.replacement

    def written(self, value: str) -> str:
        """The masked value; unlike mask(), an empty value is masked too."""
        if self.kind in ("fixed", "empty") or len(value) <= max(self.full, self.prefix + self.suffix):
            return self.opaque
        return value[: self.prefix] + self.replacement + (value[-self.suffix :] if self.suffix else "")

    def mask(self, value: str) -> str:
        return self.written(value) if value else ""

    def bounded(self, value: str, max_bytes: int) -> tuple[str, bool]:
        """mask() cut at a character boundary to max_bytes of UTF-8, and whether it was cut."""
        raw = self.mask(value).encode()
        return (raw[:max_bytes].decode("utf-8", "ignore"), True) if len(raw) > max_bytes else (raw.decode(), False)


MASKS = (Mask.preserve_edges(2, 2, "****", 4), Mask.preserve_suffix(1, "*******", 1), Mask.fixed("****"), Mask.fixed("<redacted>"))


@dataclass(frozen=True)
class Rules:
    """Names (canonical) with levels, allowed names, and what an unknown field gets."""

    sensitive: tuple[tuple[str, int], ...] = ()
    allow_exact: tuple[str, ...] = ()
    allow_suffix: tuple[str, ...] = ()
    by_suffix: bool = True
    unknown: int = 0

    @cached_property
    def levels(self) -> dict[str, int]:
        return dict(self.sensitive)

    def classify(self, name: str, exact: bool = False) -> tuple[str, str | None, str | None]:
        """('sensitive' or 'allowed' or 'unknown', the rule's name, 'exact' or 'token_suffix') by the first candidate with a rule."""
        for k, c in enumerate(candidates(name, self.by_suffix and not exact)):
            kind = "exact" if k == 0 else "token_suffix"
            if k == 0 and c in self.allow_exact or c in self.allow_suffix:
                return "allowed", c, kind
            if c in self.levels:
                return "sensitive", c, kind
        return "unknown", None, None

    def level(self, name: str, exact: bool = False, floor: bool = False) -> int:
        """0 or the strongest level of all candidates; allowed names have none, but a floor knows no allowed names."""
        if not floor and (self.allow_exact or self.allow_suffix) and self.classify(name, exact)[0] == "allowed":
            return 0
        return max((self.levels[c] for c in candidates(name, self.by_suffix and not exact) if c in self.levels), default=self.unknown)


def validate_field_name(name: str, where: str = "rules") -> str:
    """The canonical form of a name. Raises PolicyError if nothing is left of it."""
    key = canonical(name)
    if not key:
        raise PolicyError("empty field name", where)
    return key


def rules_of(names: dict[str, int], **options) -> Rules:
    merged: dict[str, int] = {}
    for name, level in names.items():
        merged[canonical(name)] = max(level, merged.get(canonical(name), 0))
    return Rules(tuple(sorted(merged.items())), **options)


STANDARD_FLOOR = rules_of({n: v for preset in PRESETS.values() for n, v in preset.items()})


@dataclass(frozen=True)
class Context:
    """Rules and floor that a format adds to the base rules; they can only raise a level."""

    rules: Rules = Rules()
    floor: Rules | None = None


@dataclass(frozen=True)
class Limits:
    max_input_bytes: int = 65_536
    max_output_bytes: int = 16_384
    max_depth: int = 32
    max_nodes: int = 1_024
    max_items: int = 256
    max_key_bytes: int = 256
    # of JSON texts; by default they are bound by the limits above
    max_json_depth: int = 128
    max_json_nodes: int = 100_000
    max_json_string_bytes: int = 65_536
    max_json_number_bytes: int = 1_024


@dataclass(frozen=True)
class Policy:
    rules: Rules = Rules()
    floor: Rules | None = STANDARD_FLOOR
    masks: tuple[Mask, Mask, Mask, Mask] = MASKS
    limits: Limits = Limits()
    header: Context = Context()
    query: Context = Context()
    body: Context = Context()
    url_path: str = "preserve"
    text_body: str = "redact"
    uri_path: str = "preserve"
    uri_fragment: str = "redact"
    unkeyed_json: str = "pass_through"
    disabled: bool = False

    def classify_field(self, name: str) -> tuple[str, str | None, str | None]:
        return self.rules.classify(name)

    def sensitivity_for(self, name: str, context: str | None = None, exact: bool = False) -> int:
        """0 for a field that passes, or the strongest of the rules, the floor and the context's own."""
        return self._level(name, context, exact)

    @cached_property
    def _level(self):
        """Levels of the names met lately; a policy never changes."""
        return lru_cache(16_384)(self._strongest)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_level"}

    def _strongest(self, name: str, context: str | None, exact: bool) -> int:
        pairs = [(self.rules, self.floor)] + ([(c.rules, c.floor)] if context and (c := getattr(self, context)) else [])
        return max(max(r.level(name, exact), f.level(name, exact, True) if f else 0) for r, f in pairs)

    def mask(self, level: int, value: str) -> str:
        return self.masks[level - 1].mask(value)

    def opaque(self, level: int) -> str:
        return self.masks[level - 1].opaque

    def builder(self) -> PolicyBuilder:
        return PolicyBuilder(self)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Policy:
        raw = json.loads(text)
        rules = lambda r: None if r is None else Rules(tuple((n, v) for n, v in r["sensitive"]), tuple(r["allow_exact"]), tuple(r["allow_suffix"]), r["by_suffix"], r["unknown"])
        context = lambda c: Context(rules(c["rules"]), rules(c["floor"]))
        return cls(**raw | {"rules": rules(raw["rules"]), "floor": rules(raw["floor"]), "masks": tuple(Mask(**m) for m in raw["masks"]), "limits": Limits(**raw["limits"])} | {k: context(raw[k]) for k in ("header", "query", "body")})

    def rule_rows(self) -> list[tuple[str, str, int | None]]:
        """(layer, canonical name, level) of all rules; allowed names have no level."""
        rows = [("application", n, v) for n, v in self.rules.sensitive]
        rows += [("allow_exact", n, None) for n in self.rules.allow_exact] + [("allow_suffix", n, None) for n in self.rules.allow_suffix]
        return rows + [("floor", n, v) for n, v in (self.floor.sensitive if self.floor else ())]


def standard() -> Policy:
    return Policy()


def strict() -> Policy:
    """Unknown fields are secret; URL paths, text bodies and unkeyed JSON are redacted."""
    return Policy(rules=Rules(unknown=SECRET), url_path="redact", text_body="redact", unkeyed_json="redact")


def disabled() -> Policy:
    return Policy(disabled=True)


_default = standard()


def application_default() -> Policy:
    return _default


def replace_application_default(policy: Policy) -> Policy:
    """Set the process-wide default for plans built from now on; returns the one before."""
    global _default
    before, _default = _default, policy
    return before


@dataclass
class RulesBuilder:
    """A draft of one layer of rules. Nothing of it takes effect before build(), which raises the first error."""

    sensitive: dict[str, int] = field(default_factory=dict)
    exact: set[str] = field(default_factory=set)
    suffix: set[str] = field(default_factory=set)
    by_suffix: bool = True
    unknown: int = 0
    where: str = "rules"
    error: PolicyError | None = None

    @classmethod
    def of(cls, rules: Rules, where: str = "rules") -> RulesBuilder:
        return cls(dict(rules.sensitive), set(rules.allow_exact), set(rules.allow_suffix), rules.by_suffix, rules.unknown, where)

    def _name(self, name: str) -> str:
        key = canonical(name)
        if not key and self.error is None:
            self.error = PolicyError("empty field name", self.where)
        return key

    def raise_level(self, level: int, *names: str) -> RulesBuilder:
        for key in map(self._name, names):
            self.sensitive[key] = max(level, self.sensitive.get(key, 0))
        return self

    def low(self, *names: str) -> RulesBuilder:
        return self.raise_level(LOW, *names)

    def medium(self, *names: str) -> RulesBuilder:
        return self.raise_level(MEDIUM, *names)

    def high(self, *names: str) -> RulesBuilder:
        return self.raise_level(HIGH, *names)

    def secret(self, *names: str) -> RulesBuilder:
        return self.raise_level(SECRET, *names)

    def override_level(self, level: int, *names: str) -> RulesBuilder:
        self.sensitive.update(dict.fromkeys(map(self._name, names), level))
        return self

    def remove(self, *names: str) -> RulesBuilder:
        for key in map(self._name, names):
            self.sensitive.pop(key, None)
        return self

    def allow_exact(self, *names: str) -> RulesBuilder:
        self.exact.update(map(self._name, names))
        return self

    def allow_suffix(self, *names: str) -> RulesBuilder:
        self.suffix.update(map(self._name, names))
        return self

    def remove_allowed(self, *names: str) -> RulesBuilder:
        keys = set(map(self._name, names))
        self.exact -= keys
        self.suffix -= keys
        return self

    def clear_allowed(self) -> RulesBuilder:
        self.exact, self.suffix = set(), set()
        return self

    def matching(self, by_suffix: bool) -> RulesBuilder:
        self.by_suffix = by_suffix
        return self

    def unknown_fields(self, level: int) -> RulesBuilder:
        self.unknown = level
        return self

    def include_preset(self, preset: str) -> RulesBuilder:
        for name, level in PRESETS[preset].items():
            self.raise_level(level, name)
        return self

    def build(self) -> Rules:
        if self.error:
            raise self.error
        return Rules(tuple(sorted(self.sensitive.items())), tuple(sorted(self.exact)), tuple(sorted(self.suffix)), self.by_suffix, self.unknown)


class PolicyBuilder:
    """Changes to a policy, each checked as it is made; build() returns a new immutable policy."""

    def __init__(self, policy: Policy | None = None):
        self._policy = policy or Policy()

    def _set(self, **changes) -> PolicyBuilder:
        self._policy = replace(self._policy, **changes)
        return self

    def fields(self, change) -> PolicyBuilder:
        draft = RulesBuilder.of(self._policy.rules)
        change(draft)
        return self._set(rules=draft.build())

    def floor(self, change) -> PolicyBuilder:
        draft = RulesBuilder.of(self._policy.floor or Rules(), "floor")
        change(draft)
        return self._set(floor=draft.build())

    def disable_floor(self) -> PolicyBuilder:
        return self._set(floor=None)

    def context(self, which: str, change=None, floor: Rules | None | bool = True) -> PolicyBuilder:
        """Rules of the header, query or body context, and its floor: True keeps it, None removes it."""
        own = getattr(self._policy, which)
        draft = RulesBuilder.of(own.rules, f"http {which}")
        if change:
            change(draft)
        return self._set(**{which: Context(draft.build(), own.floor if floor is True else floor)})

    def replace_rules(self, which: str, rules: Rules) -> PolicyBuilder:
        """All rules of a context at once; its floor stays."""
        return self._set(**{which: replace(getattr(self._policy, which), rules=rules)})

    def all_context_floors(self, floor: Rules | None) -> PolicyBuilder:
        return self._set(**{k: replace(getattr(self._policy, k), floor=floor) for k in ("header", "query", "body")})

    def mask(self, level: int, mask: Mask) -> PolicyBuilder:
        if mask.kind == "fixed" and not mask.replacement:
            raise PolicyError("empty fixed replacement", "masking")
        masks = list(self._policy.masks)
        masks[level - 1] = mask
        return self._set(masks=tuple(masks))

    def limits(self, **values: int) -> PolicyBuilder:
        for name, value in values.items():
            if not isinstance(value, int) or isinstance(value, bool) or value < 0:
                raise PolicyError(f"{name} is no size", "limits")
        if values.get("max_output_bytes", 0) > 1 << 31:
            raise PolicyError("output limit too large", "limits")
        return self._set(limits=replace(self._policy.limits, **values))

    def http(self, url_path: str | None = None, text_body: str | None = None) -> PolicyBuilder:
        return self._set(url_path=url_path or self._policy.url_path, text_body=text_body or self._policy.text_body)

    def uri(self, path: str | None = None, fragment: str | None = None) -> PolicyBuilder:
        return self._set(uri_path=path or self._policy.uri_path, uri_fragment=fragment or self._policy.uri_fragment)

    def unkeyed_json(self, policy: str) -> PolicyBuilder:
        return self._set(unkeyed_json=policy)

    def disabled(self, value: bool = True) -> PolicyBuilder:
        return self._set(disabled=value)

    def build(self) -> Policy:
        return self._policy
