"""Rule documents: strict decoding, defaults, compilation to detector rules, and the floor."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..functions.re2 import PatternError
from ..operators import detectors as d

# Closed sets, bounds and defaults of rule documents.
TYPES = ("regex", "keyword", "prefix", "email", "luhn", "jwt", "pem", "entropy", "command")
SCOPES = ("request", "response", "both")
ACTIONS = ("allow", "warn", "redact", "block")
RULE_ID = re.compile(r"[a-z][a-z0-9._-]{0,63}")
MOST_RULES, MOST_KEYWORDS, MOST_LIST, MOST_ALLOW, MOST_COMMAND, LITERAL_BYTES, PATTERN_BYTES = 256, 64, 256, 64, 16, 256, 1024
DEFAULTS = {"category": "custom", "scope": "request", "priority": 100, "confidence": 0.9}
DOCUMENT_KEYS = {"channel": str, "schema_version": int, "min_binary_version": str, "serial": int, "key_id": str, "not_before": str, "expires": str, "detectors": dict, "disabled_categories": list, "allowlist": list, "blocklist": list, "sensitive_keys": dict, "rules": list}
RULE_KEYS = {"id": str, "type": str, "category": str, "scope": str, "action": str, "priority": int, "confidence": (int, float), "pattern": str, "keywords": list, "case_sensitive": bool, "allowlist": list, "options": dict, "command": str, "subcommand": str, "verbs": list, "targets": list, "min_digits": int, "max_digits": int, "alphabet": str, "min_length": int, "min_entropy": (int, float), "pure_hex_excluded": bool, "pem_headers": list}


class RuleError(ValueError):
    """A document that is not taken; the message has the path of the fault."""


@dataclass(frozen=True)
class Pack:
    """A compiled document."""

    rules: tuple[d.Rule, ...]
    allowlist: tuple[str, ...] = ()
    blocklist: tuple[str, ...] = ()
    sensitive: tuple[str, ...] = ()
    case_sensitive: bool = False
    serial: int = 0
    detectors: Mapping[str, bool] = field(default_factory=dict)
    disabled_categories: tuple[str, ...] = ()
    origin: str = "remote_pack"
    commands: tuple[str, ...] = ()  # ids of rules that are read but not run


def _checked(raw: Any, keys: Mapping[str, Any], at: str) -> dict[str, Any]:
    if not isinstance(raw, dict):
        raise RuleError(f"{at}: an object is wanted")
    for k, v in raw.items():
        if k not in keys:
            raise RuleError(f"{at}.{k}: unknown field")
        if not isinstance(v, keys[k]) or (isinstance(v, bool) and keys[k] is not bool):
            raise RuleError(f"{at}.{k}: wrong type")
    return raw


def _literals(raw: list, most: int, at: str) -> tuple[str, ...]:
    if len(raw) > most:
        raise RuleError(f"{at}: more than {most} entries")
    for i, x in enumerate(raw):
        if not isinstance(x, str) or not 0 < len(x.encode()) <= LITERAL_BYTES:
            raise RuleError(f"{at}[{i}]: a text of 1 to {LITERAL_BYTES} bytes is wanted")
    return tuple(raw)


def canonical_suffix(raw: str) -> str:
    """A mail suffix in lower case with one leading dot."""
    text = raw.strip().lower()
    text = text if text.startswith(".") else f".{text}"
    if text == "." or ".." in text or not text.isascii() or re.search(r"\s", text) or len(text) > LITERAL_BYTES:
        raise RuleError(f"not a mail suffix: {raw!r}")
    return text


def suffixes(options: Mapping[str, Any]) -> tuple[str, ...]:
    """The built-in suffixes and the declared ones, or these alone where they replace."""
    email = _checked(options.get("email", {}), {"suffixes": list, "replace": bool}, "options.email")
    own = [canonical_suffix(x) for x in email.get("suffixes", [])]
    return tuple(dict.fromkeys([*(() if email.get("replace") else d.EMAIL_SUFFIXES), *own]))


def _rule(raw: Any, at: str, origin: str) -> d.Rule | None:
    r = _checked(raw, RULE_KEYS, at)
    spec = {k: r[k] if r.get(k) not in (None, "") else v for k, v in DEFAULTS.items()}
    spec["priority"] = r.get("priority", DEFAULTS["priority"])
    ident, kind, action = r.get("id", ""), r.get("type"), r.get("action")
    if not RULE_ID.fullmatch(ident):
        raise RuleError(f"{at}.id: not a rule id")
    if kind not in TYPES or action not in ACTIONS or spec["scope"] not in SCOPES:
        raise RuleError(f"{at}: type, action or scope is not known")
    if not 0 < float(spec["confidence"]) <= 1:
        raise RuleError(f"{at}.confidence: not in (0, 1]")
    if action == "redact" and spec["scope"] != "request":
        raise RuleError(f"{at}: only requests can be redacted")
    allow = _literals(r.get("allowlist", []), MOST_ALLOW, f"{at}.allowlist")
    more = {"action": action, "scope": spec["scope"], "priority": spec["priority"], "confidence": float(spec["confidence"]), "category": spec["category"], "allow": allow, "origin": origin}
    if kind == "command":
        for name in ("verbs", "targets"):
            _literals(r.get(name, []), MOST_COMMAND, f"{at}.{name}")
        return None
    if kind == "regex":
        pattern = r.get("pattern", "")
        if not 0 < len(pattern.encode()) <= PATTERN_BYTES:
            raise RuleError(f"{at}.pattern: empty or too long")
        try:
            return d.regex_rule(ident, pattern, **more)
        except PatternError as e:
            raise RuleError(f"{at}.pattern: {e}") from None
    if kind == "keyword":
        words = _literals(r.get("keywords", []), MOST_KEYWORDS, f"{at}.keywords")
        if not words:
            raise RuleError(f"{at}.keywords: none")
        return d.keyword_rule(ident, words, r.get("case_sensitive", False), **more)
    if kind == "email":
        options = _checked(r.get("options", {}), {"email": dict}, f"{at}.options")
        listed = suffixes(options)
        return d.Rule(ident, spans=lambda text: d.email_spans(text, listed), primitive=True, narrows=bool(options.get("email", {}).get("replace")), **more)
    spans = {"prefix": d.prefix_spans, "luhn": d.luhn_spans, "jwt": d.jwt_spans, "pem": d.pem_spans, "entropy": d.entropy_spans}[kind]
    return d.Rule(ident, spans=spans, primitive=True, **more)


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise RuleError("a field stands twice")
    return out


def compile_document(text: str | bytes, origin: str = "remote_pack") -> Pack:
    """A document's rules by priority and id; any fault refuses the whole document."""
    try:
        raw = json.loads(text, object_pairs_hook=_once)
    except json.JSONDecodeError as e:
        raise RuleError(f"not one JSON object: {e}") from None
    doc = _checked(raw, DOCUMENT_KEYS, "document")
    if doc.get("schema_version") not in (1, 2):
        raise RuleError("document.schema_version: not known")
    if len(doc.get("rules", [])) > MOST_RULES:
        raise RuleError(f"document.rules: more than {MOST_RULES}")
    rules = [_rule(r, f"document.rules[{i}]", origin) for i, r in enumerate(doc.get("rules", []))]
    kept = sorted((r for r in rules if r is not None), key=lambda r: (r.priority, r.id))
    if len({r["id"] for r in doc.get("rules", [])}) != len(rules):
        raise RuleError("document.rules: an id stands twice")
    sensitive = _checked(doc.get("sensitive_keys", {}), {"keys": list, "case_sensitive": bool}, "document.sensitive_keys")
    return Pack(
        tuple(kept), _literals(doc.get("allowlist", []), MOST_LIST, "document.allowlist"), _literals(doc.get("blocklist", []), MOST_LIST, "document.blocklist"),
        _literals(sensitive.get("keys", []), MOST_LIST, "document.sensitive_keys.keys"), sensitive.get("case_sensitive", False), doc.get("serial", 0), doc.get("detectors", {}),
        tuple(doc.get("disabled_categories", [])), origin, tuple(r["id"] for r in doc.get("rules", []) if r.get("type") == "command"))


def check_floor(pack: Pack, baseline: tuple[d.Rule, ...] = (*d.BUILTIN, d.HIGH_ENTROPY)) -> None:
    """A remote pack must not weaken what is built in, whether on or off by default.

    In this order: no detector switched off, no category disabled, no rule that allows, no
    mail rule that replaces the built-in suffixes. Packs of other origins are not checked.
    """
    if pack.origin != "remote_pack":
        return
    for r in baseline:
        if pack.detectors.get(r.id) is False:
            raise RuleError(f"detector {r.id} is switched off")
    own = {r.category for r in baseline}
    for c in pack.disabled_categories:
        if c in own:
            raise RuleError(f"category {c} is disabled")
    for r in pack.rules:
        if r.action == "allow":
            raise RuleError(f"rule {r.id} allows")
    for r in pack.rules:
        if r.narrows:
            raise RuleError(f"rule {r.id} replaces the mail suffixes")


def builtin(switches: Mapping[str, bool] | None = None) -> tuple[d.Rule, ...]:
    """The built-in rules that are on: five by default, high entropy if asked; an unknown name is refused."""
    names = {r.id: r for r in (*d.BUILTIN, d.HIGH_ENTROPY)}
    for k in switches or {}:
        if k not in names:
            raise RuleError(f"no detector {k}")
    on = {r.id: True for r in d.BUILTIN} | {d.HIGH_ENTROPY.id: False} | dict(switches or {})
    return tuple(r for k, r in names.items() if on[k])


def register(active: tuple[d.Rule, ...], added: tuple[d.Rule, ...]) -> tuple[d.Rule, ...]:
    """Both rule sets, all or nothing: an id may stand once."""
    both = (*active, *added)
    if len({r.id for r in both}) != len(both):
        raise RuleError("a rule id is taken")
    return tuple(sorted(both, key=lambda r: (r.priority, r.id)))
