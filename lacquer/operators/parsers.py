"""Small total parsers for the formats that Column expressions can't take apart; none raises on any input."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from urllib.parse import quote_from_bytes, unquote_to_bytes

from ..functions.policy import HIGH, SECRET, Policy
from .results import BIT

# Texts that stand for what can't be shown.
MARKERS = {
    "cut": "<truncated>", "url": "<redacted: invalid URL>", "nested": "<redacted: nested URL limit exceeded>",
    "query": "<redacted: invalid URL-encoded query>", "form": "<redacted: invalid URL-encoded form>",
    "form_cut": "<redacted: invalid or truncated URL-encoded form>", "content_type": "<redacted: invalid content type body>",
    "json": "<redacted: invalid JSON>", "json_cut": "<redacted: invalid or truncated JSON>", "ndjson": "<redacted: invalid NDJSON>",
    "ndjson_cut": "<redacted: invalid or truncated NDJSON>", "unkeyed": "<redacted: unkeyed JSON value>",
    "unsupported": "<redacted: unsupported HTTP body>", "text": "<redacted: text body>", "multipart": "<redacted: multipart body>",
    "part": "<redacted: multipart part>", "text_part": "<redacted: multipart text part>", "file": "<redacted: file part>",
    "unnamed": "<unnamed>", "uri": "<invalid URI>",
}
NESTED_URLS, DECODINGS = 8, 8
_ESCAPE = re.compile(r"[\x00-\x1f\x7f-\x9f\u061c\u200e\u200f\u2028-\u202e\u2066-\u2069]")
_SHORT = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}


def log_safe(text: str) -> str:
    return _ESCAPE.sub(lambda m: _SHORT.get(m[0]) or f"\\u{{{ord(m[0]):x}}}", text)


def cut_back(text: str, most: int, more: bool) -> tuple[str, bool, bool]:
    """The text, log-safe, in at most `most` bytes; whether its end is missing; and whether not even the marker had room.

    With `more` something is missing already. What is cut makes room for the
    marker that says so, and an escape is never cut in two.
    """
    marker = MARKERS["cut"]
    text = text.removesuffix(marker) if more else text
    safe = log_safe(text)
    if not more and len(safe.encode("utf-8", "replace")) <= most:
        return safe, False, False
    room = most - len(marker)
    if room < 0:
        return "", True, True
    if len(safe.encode("utf-8", "replace")) > room:
        kept, used = [], 0
        for c in text:
            atom = log_safe(c)
            used += len(atom.encode("utf-8", "replace"))
            if used > room:
                break
            kept.append(atom)
        safe = "".join(kept)
    return safe + marker, True, False


class Number(str):
    """The text of a JSON number, kept as it is written."""


class LimitReached(Exception):
    def __init__(self, reason: str):
        self.reason = reason


@dataclass
class Seen:
    """What a walk has met: the highest level, and structure against the policy's limits."""

    policy: Policy
    level: int = 0
    nodes: int = 0
    items: int = 0
    depth: int = 0

    def visit(self, depth: int, items: int = 0) -> None:
        self.nodes, self.items, self.depth = self.nodes + 1, self.items + items, max(self.depth, depth)
        limits = self.policy.limits
        if self.depth > limits.max_depth:
            raise LimitReached("depth_limit_reached")
        if self.nodes > limits.max_nodes or self.items > limits.max_items:
            raise LimitReached("traversal_limit_reached")

    def visit_json(self, value, depth: int) -> None:
        """A value of a JSON tree, against the limits of all structure, of keys, and of JSON."""
        limits = self.policy.limits
        self.visit(depth, len(value) if isinstance(value, (dict, list)) else 0)
        if depth > limits.max_json_depth:
            raise LimitReached("depth_limit_reached")
        large = self.nodes > limits.max_json_nodes
        if isinstance(value, Number):
            large |= len(value) > limits.max_json_number_bytes
        elif isinstance(value, str):
            large |= len(value) > limits.max_json_string_bytes or len(value.encode("utf-8", "replace")) > limits.max_json_string_bytes
        elif isinstance(value, dict):
            large |= any(len(k.encode("utf-8", "replace")) > limits.max_key_bytes for k in value)
        if large:
            raise LimitReached("traversal_limit_reached")

    def scalars(self, values: list, depth: int) -> bool:
        """Take a list of scalars at once, if that is what it is and none can be over a limit; otherwise they are to be visited one by one."""
        kinds, limits, nodes = set(map(type, values)), self.policy.limits, self.nodes + len(values)
        if kinds & {dict, list} or not values or nodes > min(limits.max_nodes, limits.max_json_nodes) or depth > min(limits.max_depth, limits.max_json_depth):
            return False
        if kinds & {str, Number} and 4 * max(len(v) for v in values if isinstance(v, str)) > min(limits.max_json_number_bytes, limits.max_json_string_bytes):
            return False
        self.nodes, self.depth = nodes, max(self.depth, depth)
        return True

    def mask(self, level: int, text: str) -> str:
        self.level = max(self.level, level)
        return self.policy.mask(level, text) if level else text


def _no_constant(name: str):
    raise ValueError(name)


def parse_json(text: str):
    """The value of one JSON text. Raises ValueError or RecursionError if it is not one."""
    value = json.loads(text, parse_float=Number, parse_int=Number, parse_constant=_no_constant)
    text.encode()
    return value


def _dump_text(text: str) -> str:
    out = json.dumps(text, ensure_ascii=False)
    out.encode()  # a lone surrogate is no text
    return out


def dump_json(value) -> str:
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, str):
        return _dump_text(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_dump_text(k)}:{dump_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(value if set(map(type, value)) == {Number} else map(dump_json, value)) + "]"
    return json.dumps(value)


def redact_tree(value, seen: Seen, context: str | None, marker: str, key: str | None = None, depth: int = 1):
    """The tree with sensitive keys masked; scalars of the root and of arrays have no key and follow the policy for those."""
    policy = seen.policy
    level = policy.sensitivity_for(key, context) if key is not None else 0
    seen.visit_json(value, depth)
    if level:
        if isinstance(value, str) and not isinstance(value, Number):
            return seen.mask(level, value)
        seen.level = max(seen.level, level)
        return policy.opaque(level)
    if isinstance(value, dict):
        return {k: redact_tree(v, seen, context, marker, k, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        if seen.scalars(value, depth + 1):
            return [marker] * len(value) if policy.unkeyed_json == "redact" else value
        return [redact_tree(v, seen, context, marker, None, depth + 1) for v in value]
    if key is None and policy.unkeyed_json == "redact":
        return marker
    return value


def percent_ok(text: bytes) -> bytes | None:
    """The bytes with percent escapes decoded; null if an escape is broken or the result is not UTF-8."""
    if re.search(rb"%(?![0-9A-Fa-f]{2})", text):
        return None
    raw = unquote_to_bytes(text)
    try:
        raw.decode()
    except UnicodeDecodeError:
        return None
    return raw


def form_encode(text: str) -> str:
    return quote_from_bytes(text.encode(), safe="*-._ ").replace("~", "%7E").replace(" ", "+")


def form_pairs(text: str) -> list[tuple[str, str]]:
    decode = lambda s: unquote_to_bytes(s.replace("+", " ")).decode("utf-8", "replace")
    return [(decode(k), decode(v)) for k, _, v in (p.partition("=") for p in text.split("&") if p)]


def redact_form(text: str, seen: Seen, context: str) -> str:
    out = []
    for key, value in form_pairs(text):
        seen.visit(1, 1)
        out.append(f"{form_encode(key)}={form_encode(seen.mask(seen.policy.sensitivity_for(key, context), value))}")
    return "&".join(out)


@dataclass
class Url:
    scheme: str
    user: str
    password: str | None
    host: str | None
    port: str
    path: str
    query: str | None
    fragment: str | None
    opaque: bool


_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_CONTROL = "".join(map(chr, range(33)))


def _encode(text: str, also: str) -> str:
    return "".join(c if " " < c < "\x7f" and c not in also else quote_from_bytes(c.encode(), safe="") for c in text)


def _host(text: str) -> str | None:
    if text.startswith("["):
        return text.lower() if re.fullmatch(r"\[[0-9A-Fa-f:.]+\]", text) else None
    try:
        name = unquote_to_bytes(text).decode()
        name = name.lower() if name.isascii() else name.encode("idna").decode()
    except (UnicodeError, ValueError):
        return None
    return None if not name or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]", name) else name


def parse_url(text: str) -> Url | None:
    """A URL as browsers normalise it: case of scheme and host, default ports, dot segments, percent encoding."""
    text = re.sub("[\t\n\r]", "", text.strip(_CONTROL))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text)
    if not m:
        return None
    scheme, rest = m[1].lower(), text[m.end() :]
    rest, hashed, fragment = rest.partition("#")
    special = scheme in _PORTS
    before, asked, query = rest.partition("?")
    query = _encode(query, '"#<>' + "'" * special) if asked else None
    fragment = _encode(fragment, '"<>`') if hashed else None
    if special:
        before = "//" + before.replace("\\", "/").lstrip("/")
    if not before.startswith("//"):
        if before.startswith("/"):
            return Url(scheme, "", None, None, "", _path(before), query, fragment, False)
        return Url(scheme, "", None, None, "", _encode(before, ""), query, fragment, True)
    authority, slash, path = before[2:].partition("/")
    credentials, _, place = authority.rpartition("@")
    user, _, password = credentials.partition(":")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", place)
    if not m or m[2] and int(m[2][-6:]) > 65535:
        return None
    host = _host(m[1]) if m[1] else (None if special else "")
    if host is None:
        return None
    port = (m[2] or "").lstrip("0") or ("0" if m[2] else "")
    inside = '"#<>?`{}/:;=@[\\]^|'
    return Url(scheme, _encode(user, inside), _encode(password, inside) if password else None, host, "" if port == _PORTS.get(scheme) else port, _path(slash + path) or ("/" if special else ""), query, fragment, False)


def _path(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        dots = part.lower().replace("%2e", ".")
        if dots == "..":
            out = out[:-1]
        elif dots != ".":
            out.append(part)
        if dots in (".", "..") and k == len(parts) - 1:
            out.append("")
    return "".join("/" + _encode(p, '"#<>?`{}') for p in out)


def nested_url(text: str) -> Url | str | None:
    """A web address in a query value, decoded up to 8 times; a marker if it is broken or too deep; null if it is none."""
    broken = False
    for turn in range(DECODINGS + 1):
        if (url := parse_url(text)) is not None:
            return None if url.scheme not in ("http", "https") else MARKERS["url"] if broken else url
        low = text[:8].lower()
        if low.startswith(("http://", "https://")) or broken and low.startswith("http"):
            return MARKERS["url"]
        if turn == DECODINGS:
            return MARKERS["nested"] if "%" in text else None
        good = re.match(r"(?:[^%]|%[0-9A-Fa-f]{2})*", text)[0]
        raw = unquote_to_bytes(good)
        plain = raw.decode("utf-8", "ignore")
        whole = good == text and plain.encode() == raw
        if whole and "%" not in text or not whole and not plain:
            return None
        broken, text = broken or not whole, plain
    return MARKERS["nested"]


def redact_url(url: Url, seen: Seen, depth: int = 0) -> str:
    policy = seen.policy
    out = [url.scheme, ":"]
    if url.opaque:
        out.append(url.path)
    else:
        out.append("//")
        if url.user:
            out.append(seen.mask(HIGH, url.user))
        if url.password is not None:
            out += [":", seen.mask(SECRET, url.password)]
        if url.user or url.password is not None:
            out.append("@")
        out += [url.host or "", ":" + url.port if url.port else ""]
        out.append("/<redacted>" if policy.url_path == "redact" and url.path != "/" else url.path)
    if url.query is not None:
        out += ["?", redact_query(url.query, seen, depth)]
    if url.fragment is not None:
        out += ["#", seen.mask(HIGH, url.fragment)]
    return "".join(out)


def redact_query(query: str, seen: Seen, depth: int) -> str:
    if percent_ok(query.encode()) is None:
        return MARKERS["query"]
    out = []
    for key, value in form_pairs(query):
        seen.visit(depth + 1, 1)
        if level := seen.policy.sensitivity_for(key, "query"):
            value = seen.mask(level, value)
        elif isinstance(inner := nested_url(value), str):
            value = inner
        elif inner is not None:
            value = redact_url(inner, seen, depth + 1) if depth < NESTED_URLS else MARKERS["nested"]
        out.append(f"{form_encode(key)}={form_encode(value)}")
    return "&".join(out)


_URI = re.compile(
    r"(?P<scheme>[A-Za-z][A-Za-z0-9+.-]*):(?://(?P<authority>(?:(?:[\w.~!$&'()*+,;=:-]|%[0-9A-Fa-f]{2})*@)?(?:\[[0-9A-Fa-f:.]+\]|(?:[\w.~!$&'()*+,;=-]|%[0-9A-Fa-f]{2})*)(?::[0-9]*)?)(?=[/?#]|\Z))?"
    r"(?P<path>(?:[\w.~!$&'()*+,;=:@/-]|%[0-9A-Fa-f]{2})*)(?:\?(?P<query>(?:[\w.~!$&'()*+,;=:@/?-]|%[0-9A-Fa-f]{2})*))?(?:#(?P<fragment>(?:[\w.~!$&'()*+,;=:@/?-]|%[0-9A-Fa-f]{2})*))?",
    re.ASCII,
)


def redact_uri(text: str, seen: Seen) -> str | None:
    """A generic URI with its spelling kept; null if it is none or an escape in a value is no text."""
    m = _URI.fullmatch(text)
    if not m or m["authority"] is None and m["path"].startswith("//"):
        return None
    policy = seen.policy

    def component(level: int, raw: str) -> str | None:
        plain = percent_ok(raw.encode())
        if plain is None:
            return None
        if not level:
            return raw
        seen.level = max(seen.level, level)
        return quote_from_bytes(policy.masks[level - 1].written(plain.decode()).encode(), safe="-._~!$'()*+,;=:") if plain else ""

    out: list[str | None] = [m["scheme"], ":"]
    if m["authority"] is not None:
        credentials, at, host = m["authority"].rpartition("@")
        out.append("//")
        if at:
            user, colon, password = credentials.partition(":")
            out += [component(policy.sensitivity_for("username"), user), colon, component(policy.sensitivity_for("password"), password) if colon else "", "@"]
        out.append(host)
    hide = policy.uri_path == "redact" and m["path"] not in ("", "/")
    out.append(("/" if m["path"].startswith("/") else "") + "%3Credacted%3E" if hide else m["path"])
    if m["query"] is not None:
        out.append("?")
        for k, pair in enumerate(m["query"].split("&")):
            seen.visit(1, 1)
            key, equals, value = pair.partition("=")
            name = percent_ok(key.encode())
            shown = None if name is None else component(policy.sensitivity_for(name.decode()), value) if equals else ""
            out += ["&" * (k > 0), key, equals, shown]
    if m["fragment"] is not None:
        out.append("#")
        if policy.uri_fragment == "redact" and m["fragment"]:
            seen.level = max(seen.level, HIGH)
            out.append(quote_from_bytes(policy.opaque(HIGH).encode(), safe="-._~!$'()*+,;=:"))
        else:
            out.append(m["fragment"])
    return None if any(x is None for x in out) else "".join(out)


_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
_PARAMETER = re.compile(rf';[ \t]*({_TOKEN})=(?:({_TOKEN})|"((?:[^"\\]|\\.)*)")[ \t]*')


def content_type(text: str) -> tuple[str, dict[str, str]] | None:
    """Kind (json, ndjson, form, multipart, form-data, text or other) and parameters; null if it is malformed."""
    m = re.match(rf"[ \t]*({_TOKEN}/{_TOKEN})[ \t]*", text)
    if not m:
        return None
    at, parameters = m.end(), {}
    while at < len(text):
        if text[at:].strip(" \t;") == "":
            break
        p = _PARAMETER.match(text, at)
        if not p or p[1].lower() in parameters:
            return None
        parameters[p[1].lower()] = p[2] if p[2] is not None else re.sub(r"\\(.)", r"\1", p[3])
        at = p.end()
    kind, _, sub = m[1].lower().partition("/")
    if sub == "json" or sub.endswith("+json"):
        return "json", parameters
    if f"{kind}/{sub}" in ("application/x-ndjson", "application/ndjson"):
        return "ndjson", parameters
    if f"{kind}/{sub}" == "application/x-www-form-urlencoded":
        return "form", parameters
    if kind == "multipart":
        good = re.fullmatch(r"[0-9A-Za-z'()+_,./:=? -]{0,69}[0-9A-Za-z'()+_,./:=?-]", parameters.get("boundary", ""))
        return ("form-data" if sub == "form-data" else "multipart"), parameters if good else {}
    return ("text" if kind == "text" else "other"), parameters


def redact_lines(text: str, seen: Seen) -> str:
    """NDJSON, line by line; blank lines stay. Raises ValueError at a line that is no JSON."""
    end = "\n" * text.endswith("\n")
    lines = text.removesuffix("\n").split("\n") if text else []
    return "\n".join(dump_json(redact_tree(parse_json(line), seen, "body", MARKERS["unkeyed"])) if line.strip() else "" for line in lines) + end


def redact_multipart(body: bytes, boundary: str, strict: bool, seen: Seen) -> str | None:
    """name=value lines of the parts; null if the framing is broken."""
    edge = re.escape(b"--" + boundary.encode())
    m = re.fullmatch(rb"(?s)(?:.*?\r?\n)??" + edge + rb"[ \t]*\r?\n(.*?)\r?\n" + edge + rb"--[ \t]*(?:\r?\n.*)?", body)
    if not m:
        return None
    out = []
    for part in re.split(rb"\r?\n" + edge + rb"[ \t]*\r?\n", m[1]):
        seen.visit(2, 1)
        head, gap, content = part.partition(b"\r\n\r\n") if b"\r\n\r\n" in part else part.partition(b"\n\n")
        if not gap:
            return None
        fields = {k.strip().lower(): v.strip() for k, _, v in (h.partition(":") for h in head.decode("utf-8", "replace").splitlines())}
        where = fields.get("content-disposition", "")
        if strict and not where.lower().startswith("form-data"):
            return None
        given = {p[1].lower(): p[2] if p[2] is not None else re.sub(r"\\(.)", r"\1", p[3]) for p in _PARAMETER.finditer(where)}
        out.append(f" {given.get('name') or MARKERS['unnamed']}={_part(given, fields.get('content-type'), content, seen)}")
    return "<multipart>\n" + "\n".join(out) + "\n</multipart>"


def _part(given: dict[str, str], kind: str | None, content: bytes, seen: Seen) -> str:
    name = given.get("name")
    if "filename" in given or "filename*" in given:
        return MARKERS["file"]
    if not name:
        return MARKERS["part"]
    try:
        text = content.decode()
        if level := seen.policy.sensitivity_for(name, "body"):
            return seen.mask(level, text)
        parsed = content_type(kind) if kind else ("text", {})
        if parsed is None:
            return MARKERS["part"]
        if parsed[0] == "json":
            return dump_json(redact_tree(parse_json(text), seen, "body", MARKERS["unkeyed"], depth=3))
        if parsed[0] == "ndjson":
            return redact_lines(text, seen)
        if parsed[0] == "form":
            return MARKERS["part"] if percent_ok(content) is None else redact_form(text, seen, "body")
        if parsed[0] == "text":
            return text if seen.policy.text_body == "pass_through" else MARKERS["text_part"]
    except (ValueError, RecursionError):
        pass
    return MARKERS["part"]


def redact_body(body: bytes, kind: str | None, cut: bool, seen: Seen) -> tuple[str, tuple[str, ...]]:
    """The shown body, not yet escaped, and the names of the reasons that only inspection reports apart from the known ones."""
    if not body:
        return "", ()
    parsed = content_type(kind) if kind is not None else None
    if kind is not None and parsed is None:
        return MARKERS["content_type"], ("invalid_content_type",)
    form = parsed[0] if parsed else "json" if body.strip(b" \t\n\r\x0c")[:1] in (b"{", b"[") else "other"
    try:
        if form in ("multipart", "form-data"):
            shown = None if cut or "boundary" not in parsed[1] else redact_multipart(body, parsed[1]["boundary"], form == "form-data", seen)
            return (MARKERS["multipart"], ("invalid_multipart",)) if shown is None else (shown, ())
        if form == "ndjson":
            return (MARKERS["ndjson_cut"], ("invalid_json",)) if cut else (redact_lines(body.decode(), seen), ())
        if form == "json":
            if cut:
                return MARKERS["json_cut"], ("invalid_json",)
            if body[:1] == b"[" and len(body) > seen.policy.limits.max_output_bytes:
                return MARKERS["cut"], ("output_limit_reached",)
            return dump_json(redact_tree(parse_json(body.decode()), seen, "body", MARKERS["unkeyed"])), ()
        if form == "form":
            if cut:
                return MARKERS["form_cut"], ("invalid_form",)
            return (MARKERS["form"], ("invalid_form",)) if percent_ok(body) is None else (redact_form(body.decode(), seen, "body"), ())
    except (ValueError, RecursionError):
        return MARKERS["ndjson" if form == "ndjson" else "json" if form == "json" else "form"], ("invalid_form" if form == "form" else "invalid_json",)
    try:
        text = body.decode()
    except UnicodeDecodeError:
        return f"<binary {len(body)} bytes>", ()
    if form == "text":
        return (text, ()) if seen.policy.text_body == "pass_through" else (MARKERS["text"], ())
    return MARKERS["unsupported"], ("unsupported_content_type",)


def mask_bits(names: tuple[str, ...]) -> int:
    return sum(BIT[n] for n in set(names))
