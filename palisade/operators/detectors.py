"""Detectors: each turns a text column into an array of byte spans.

Everything is a Column expression, so a rule set becomes one projection; rules are
unrolled into the plan instead of being joined to the rows. Literals of keyword rules,
blocklists and allowlists are unrolled while they are few; more of them are looked for by
one automaton in one Arrow pass over the texts, and their rules read what it found.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.automaton import literals_of, slices
from ..functions.re2 import PatternError, java, needed
from ..functions.spans import let, literal_matches, matches, trimmed_to
from ..functions.text import entropy, free_name, luhn_valid

# Patterns of the detectors.
KEY_SHAPES = (r"sk-[A-Za-z0-9_-]{16,}|AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}"
              r"|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36,}")
KEY_RUN = r"[A-Za-z0-9_-]+"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
# The same matches in one pass: a run of local characters is tried at its start only, or where a match has just ended.
EMAIL_SCAN = r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
CARD_RUN = r"[0-9][0-9 -]*"
LONG_CARD_RUN = r"[0-9][0-9 -]{12,}"
JWT_RUN = r"[A-Za-z0-9_.=-]+"
JWT = r"[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+"
PEM_HEAD = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
ENTROPY_RUN = r"[A-Za-z0-9+/_=-]{16,}"
ENTROPY_LENGTH, ENTROPY_BITS = 28, 4.0
SENSITIVE_ID = "sensitive_key"

# Public mail suffixes.
EMAIL_SUFFIXES = (
    ".com", ".org", ".net", ".edu", ".gov", ".mil", ".int",
    ".info", ".biz", ".name", ".pro", ".app", ".dev", ".io", ".ai",
    ".co", ".me", ".tv", ".cc", ".xyz", ".online", ".site", ".tech", ".cloud", ".email",
    ".cn", ".com.cn", ".net.cn", ".org.cn", ".gov.cn",
    ".hk", ".com.hk", ".tw", ".com.tw", ".jp", ".co.jp", ".kr", ".co.kr",
    ".uk", ".co.uk", ".de", ".fr", ".it", ".es", ".nl", ".be", ".ch", ".at", ".se", ".no", ".dk", ".fi", ".pl", ".cz", ".ro", ".hu", ".gr", ".pt", ".ie", ".ru",
    ".br", ".com.br", ".mx", ".com.mx", ".ar", ".com.ar", ".cl",
    ".in", ".co.in", ".au", ".com.au", ".nz", ".co.nz", ".sg", ".com.sg", ".my", ".com.my", ".id", ".co.id", ".th", ".co.th", ".ph", ".vn", ".tr", ".za", ".co.za", ".ae", ".sa", ".il", ".us", ".eu", ".ca",
)


def prefix_spans(text: Column) -> Column:
    """Provider keys: known shapes that no token character touches."""
    return matches(text, f"(?<![A-Za-z0-9_-])(?:{KEY_SHAPES})(?![A-Za-z0-9_-])")


def email_spans(text: Column, suffixes: Sequence[str] = EMAIL_SUFFIXES) -> Column:
    """Addresses below a listed suffix, without doubled dots."""
    listed = F.array(*[F.lit(s) for s in suffixes])

    def ok(s: Column) -> Column:
        domain = F.concat(F.lit("."), F.lower(F.substring_index(s["value"], "@", -1)))
        return ~F.contains(s["value"], F.lit("..")) & F.exists(listed, lambda x: F.endswith(domain, x))

    return F.filter(matches(text, EMAIL_SCAN, "@"), ok)


def luhn_spans(text: Column) -> Column:
    """Payment cards: runs of digits, blanks and dashes with 13 to 19 digits and a valid checksum."""
    runs = F.transform(matches(text, LONG_CARD_RUN), lambda s: trimmed_to(s, F.rtrim(s["value"], F.lit(" -"))))
    return F.filter(runs, lambda s: luhn_valid(F.translate(s["value"], " -", "")))


def jwt_spans(text: Column) -> Column:
    """Tokens of three segments whose first is a JSON object with the key ``alg``."""

    def ok(s: Column) -> Column:
        header = F.rtrim(F.translate(F.substring_index(s["value"], ".", 1), "-_", "+/"), F.lit("="))
        decoded = F.try_to_binary(header, F.lit("base64")).cast("string")
        shaped = F.coalesce(decoded.rlike(r'^\s*\{\s*"[\s\S]*\}\s*$'), F.lit(False)) & F.is_valid_utf8(decoded)
        return shaped & F.coalesce(F.array_contains(F.json_object_keys(decoded), "alg"), F.lit(False))

    return F.filter(matches(text, f"(?<![A-Za-z0-9_.=-]){JWT}(?![A-Za-z0-9_.=-])"), ok)


def pem_spans(text: Column) -> Column:
    """Private keys from each header to its own footer, or to the end of the text."""
    raw = text.cast("binary")

    def whole(both: Column) -> Column:
        # one character a byte, so that places are offsets; after the last footer of any kind nothing is looked for
        latin, raw = both["latin"], both["raw"]

        def one(s: Column) -> Column:
            footer = F.replace(s["value"], F.lit("BEGIN"), F.lit("END"))
            at = F.when(s["end"] <= both["last"], F.call_function("locate", footer, latin, s["end"] + 1)).otherwise(0)
            end = F.when(at > 0, at - 1 + F.octet_length(footer)).otherwise(F.octet_length(raw))
            return F.struct(s["start"].alias("start"), end.cast("int").alias("end"), F.substring(raw, s["start"] + 1, end - s["start"]).cast("string").alias("value"))

        return F.transform(both["found"], one)

    def prepared(f: Column) -> Column:
        latin = F.decode(raw, "ISO-8859-1")
        last = F.when(F.contains(text, F.lit("-----END ")), F.octet_length(raw) - F.length(F.substring_index(latin, "-----END ", -1)) - 9).otherwise(-1)
        return let(F.struct(latin.alias("latin"), raw.alias("raw"), f.alias("found"), last.alias("last")), whole)

    return let(matches(text, PEM_HEAD, "-----BEGIN "), lambda f: F.when(F.size(f) > 0, prepared(f)).otherwise(f))


def entropy_spans(text: Column) -> Column:
    """Long runs that are not hexadecimal and have at least four bits a character."""
    return F.filter(matches(text, ENTROPY_RUN), lambda s: (F.length(s["value"]) >= ENTROPY_LENGTH) & ~s["value"].rlike("^[0-9a-fA-F-]+$") & (entropy(s["value"]) >= ENTROPY_BITS))


@dataclass(frozen=True)
class Rule:
    """A rule; ``spans`` builds its spans from a text column, ``allow`` lists literals that excuse a span."""

    id: str
    category: str
    spans: Callable[[Column], Column]
    action: str = "redact"
    scope: str = "request"
    priority: int = 100
    confidence: float = 0.9
    origin: str = "builtin"
    primitive: bool = False  # a built-in algorithm: scans no more than the byte budget
    narrows: bool = False  # a mail rule that does without the built-in suffixes
    allow: tuple[str, ...] = field(default=())
    literals: tuple[str, ...] = field(default=())  # of a rule that is nothing but these
    fold: bool = False  # whether its literals are compared without the case of A-Z
    python: Callable[[bytes], Iterable[tuple[int, int]]] | None = None  # a rule of another origin, run under guard


BUILTIN = (
    Rule("prefix", "api_key", prefix_spans, confidence=0.95, primitive=True),
    Rule("email", "email", email_spans, confidence=0.8, primitive=True),
    Rule("luhn", "credit_card", luhn_spans, primitive=True),
    Rule("jwt", "jwt", jwt_spans, confidence=0.95, primitive=True),
    Rule("private_key", "private_key", pem_spans, confidence=0.99, primitive=True),
)
HIGH_ENTROPY = Rule("high_entropy", "high_entropy", entropy_spans, confidence=0.6, primitive=True)


def regex_rule(id: str, pattern: str, category: str = "custom", **more) -> Rule:
    """A rule of a pattern with RE2's syntax and meaning; one that can match an empty text is refused."""
    try:
        translated, needs = java(pattern), needed(pattern)
    except PatternError as e:
        raise PatternError(f"rule {id}: {e}") from None
    return Rule(id, category, lambda text: matches(text, translated, needs), **more)


def keyword_rule(id: str, keywords: Sequence[str], case_sensitive: bool = False, category: str = "custom", **more) -> Rule:
    """A rule of literals, grouped by keyword."""
    return Rule(id, category, lambda text: F.concat(*[literal_matches(text, k, not case_sensitive) for k in keywords]), literals=tuple(keywords), fold=not case_sensitive, **more)


# What a guarded rule may give and take, and how its failures are named.
MOST_SPANS, MOST_SECONDS = 4096, 30.0
PANIC, TIMEOUT, BUDGET, MALFORMED, ERROR = "panic", "timeout", "budget", "malformed", "error"
FAILED = "failed:"


def python_rule(id: str, spans: Callable[[bytes], Iterable[tuple[int, int]]], category: str = "custom", **more) -> Rule:
    """A rule in Python: from the bytes of a text to (start, end) spans; the rest of a finding is stamped here.

    It is called under guard (:func:`guarded`), and a failure refuses the whole text.
    """
    more.setdefault("origin", "plugin")
    return Rule(id, category, lambda text: F.array().cast("array<struct<start:int,end:int,value:string>>"), python=spans, **more)


def guarded(rule: Rule, text: bytes, seconds: float = MOST_SECONDS) -> tuple[list[tuple[int, int]], str | None]:
    """The checked spans of a Python rule in a text, or none and the reason why it failed.

    An exception is a panic, no spans at all (None) an error, more than ``MOST_SPANS`` the
    budget, and anything but whole pairs in order within the text, at borders of
    characters, malformed. A call cannot be stopped; one that took too long fails after it.
    """
    began, out = time.monotonic(), []
    try:
        found = rule.python(text)
        if found is None:
            return [], ERROR
        for n, span in enumerate(found):
            if n == MOST_SPANS:
                return [], BUDGET
            out.append(span)
    except Exception:
        return [], PANIC
    if time.monotonic() - began > seconds:
        return [], TIMEOUT
    inside = lambda at: at == len(text) or text[at] & 0xC0 != 0x80
    for span in out:
        whole = isinstance(span, tuple) and len(span) == 2 and all(isinstance(x, int) and not isinstance(x, bool) for x in span)
        if not whole or not 0 <= span[0] < span[1] <= len(text) or not inside(span[0]) or not inside(span[1]):
            return [], MALFORMED
    return out, None


_REASONS = (PANIC, TIMEOUT, BUDGET, MALFORMED, ERROR)


def blocklist_rule(literals: Sequence[str]) -> Rule:
    """Global literals that block and that no allowlist excuses."""
    return Rule("blocklist", "custom", lambda text: F.concat(*[literal_matches(text, x) for x in literals]), action="block", scope="both", priority=-1, confidence=1.0, literals=tuple(literals))


def excused(span: Column, raw: Column, literals: Sequence[str]) -> Column:
    """Whether ``span`` lies within an occurrence of a literal in the bytes ``raw``, overlapping ones included."""

    def by(literal: str) -> Column:
        size = len(literal.encode())
        places = F.sequence(F.greatest(span["end"] - size, F.lit(0)), span["start"])
        found = F.exists(places, lambda p: F.substring(raw, p + 1, F.lit(size)) == F.lit(literal.encode()))
        return F.when(span["end"] - span["start"] <= size, found).otherwise(F.lit(False))

    out = F.lit(False)
    for x in literals:
        out = out | by(x)
    return out


# literals that are unrolled into the plan; more are looked for by an automaton
UNROLLED = 16
PLACES = "array<struct<owner:int,start:int,end:int>>"


def _owners(rules: Sequence[Rule], allowlist: Sequence[str], phase: str) -> tuple[tuple, tuple]:
    """(literal, fold, owner) of rules, by rank, and of allowlists: the number of rules for the global one, more by rank for each rule's."""
    own = ranked(rules, phase)
    seek = tuple((x.encode(), r.fold, n) for n, r in enumerate(own) for x in r.literals)
    allow = (*((x.encode(), False, len(own)) for x in allowlist), *((x.encode(), False, len(own) + 1 + n) for n, r in enumerate(own) for x in r.allow))
    return seek, allow


def needs_places(rules: Sequence[Rule], allowlist: Sequence[str] = (), phase: str = "request") -> bool:
    """Whether a rule set has more literals than a plan should hold, or rules in Python."""
    return sum(map(len, _owners(rules, allowlist, phase))) > UNROLLED or any(r.python for r in ranked(rules, phase))


def with_places(df: DataFrame, rules: Sequence[Rule], name: str, text: str = "text", allowlist: Sequence[str] = (), phase: str = "request", leaves: bool = False) -> DataFrame:
    """``df`` with the places (owner, start, end) of all literals of the rules and allowlists in each text; one Arrow pass.

    With ``leaves``, ``text`` is an array of structs with a ``value``, and the places are an
    array for each. Rules in Python add theirs in the order of rules up to the first that
    fails: that is the place (owner, -1, number of the reason).
    """
    seek, allow = _owners(rules, allowlist, phase)
    own = [(n, r) for n, r in enumerate(ranked(rules, phase)) if r.python]

    def told(texts: pa.Array) -> list[np.ndarray]:
        rows = []
        for i, text in enumerate(texts.to_pylist()):
            for n, rule in own if text else ():
                spans, failure = guarded(rule, text.encode())
                rows += [(i, a, z, n) for a, z in spans]
                if failure:
                    rows.append((i, -1, _REASONS.index(failure), n))
                    break
        return list(np.array(rows, np.int64).reshape(-1, 4).T)
    kind = pa.list_(pa.struct([("owner", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DataType.fromDDL(f"array<{PLACES}>" if leaves else PLACES))])

    def placed(column: pa.Array) -> pa.Array:
        parts = []
        for part in slices(column):
            found = [np.concatenate(x) for x in zip(literals_of(seek).spans(part), literals_of(allow).spans(part, overlapping=True), told(part), strict=True)]
            order = np.argsort(found[0], kind="stable")
            row, start, end, owner = (x[order] for x in found)
            values = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (owner, start, end)], names=["owner", "start", "end"])
            parts.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)), values, kind))
        return pa.concat_arrays(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(at)
            if leaves:
                sizes = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = column.flatten().field("value")
                inner = placed(values) if len(values) else pa.array([], kind)
                made = pa.ListArray.from_arrays(pa.array(offsets), inner)
            else:
                made = placed(column)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def _at_places(text: Column, places: Column, owner: int) -> Column:
    """The spans of one owner as the expressions of few literals give them."""
    own = F.filter(places, lambda p: (p["owner"] == owner) & (p["start"] >= 0))
    cut = lambda raw: F.transform(own, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.substring(raw, p["start"] + 1, p["end"] - p["start"]).cast("string").alias("value")))
    return F.when(F.exists(places, lambda p: p["owner"] == owner), let(text.cast("binary"), cut)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _unexcused_at(spans: Column, places: Column, owners: Sequence[int]) -> Column:
    allowed = F.filter(places, lambda p: p["owner"].isin(*owners))
    return let(spans, lambda s: F.when(F.size(s) > 0, let(allowed, lambda a: F.filter(s, lambda x: ~F.exists(a, lambda p: (p["start"] <= x["start"]) & (p["end"] >= x["end"]))))).otherwise(s))


def _unexcused(spans: Column, text: Column, literals: Sequence[str]) -> Column:
    some = lambda s: F.when(F.size(s) > 0, let(text.cast("binary"), lambda raw: F.filter(s, lambda x: ~excused(x, raw, literals)))).otherwise(s)
    return let(spans, some)


def _stamped(spans: Column, rule: Rule, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rule_rank"), F.lit(rule.id).alias("rule_id"), s["value"].alias("value"), F.lit(rule.category).alias("category"),
        F.lit(rule.action).alias("action"), F.lit(rule.confidence).alias("confidence"), F.lit(rule.origin).alias("origin")))


def _failures(places: Column, rule: Rule, rank: int) -> Column:
    """The failure of a Python rule as a finding without a place, whose action names the reason."""
    reasons = F.array(*[F.lit(FAILED + x) for x in _REASONS])
    failed = F.filter(places, lambda p: (p["owner"] == rank) & (p["start"] == -1))
    return F.transform(failed, lambda p: F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(rank).alias("rule_rank"), F.lit(rule.id).alias("rule_id"), F.lit("").alias("value"), F.lit(rule.category).alias("category"),
        F.element_at(reasons, p["end"] + 1).alias("action"), F.lit(rule.confidence).alias("confidence"), F.lit(rule.origin).alias("origin")))


FINDINGS = "array<struct<start:int,end:int,rule_rank:int,rule_id:string,value:string,category:string,action:string,confidence:double,origin:string>>"


def cut_to(text: Column, budget: int) -> Column:
    """The first ``budget`` bytes of a text, without a character that would be cut."""
    part = F.substring(text.cast("binary"), 1, budget).cast("string")
    whole = F.when(F.is_valid_utf8(part), part).otherwise(F.rtrim(F.make_valid_utf8(part), F.lit("\ufffd")))
    return F.when(F.octet_length(text) > budget, whole).otherwise(text)


def ranked(rules: Sequence[Rule], phase: str = "request") -> list[Rule]:
    """The rules of a phase by priority and id."""
    return sorted((r for r in rules if r.scope in (phase, "both")), key=lambda r: (r.priority, r.id))


def found(text: Column, rules: Sequence[Rule] = BUILTIN, allowlist: Sequence[str] = (), phase: str = "request", budget: int | None = None, gated: Column | None = None, gate_allow: Column | None = None, places: Column | None = None) -> Column:
    """Every finding in a text as an array, by start, end and rule.

    Rules of another phase are not planned at all; ``budget`` limits the bytes that the
    built-in algorithms scan, not those of pattern, keyword and block rules. Where
    ``gated`` is true, rules that redact are skipped and the whole value is one finding
    of the sensitive-key gate, unless ``gate_allow``. Empty and null texts have none.
    With ``places`` (:func:`with_places`) no literal is in the plan.
    """
    arrays, own = [], ranked(rules, phase)
    for rank, rule in enumerate(own):
        if places is not None and (rule.literals or rule.python):
            spans = _at_places(text, places, rank)
        else:
            spans = rule.spans(cut_to(text, budget) if budget is not None and rule.primitive else text)
        literals = (*allowlist, *rule.allow)
        if literals and rule.id != "blocklist":
            spans = _unexcused(spans, text, literals) if places is None else _unexcused_at(spans, places, (len(own), len(own) + 1 + rank))
        made = _stamped(spans, rule, rank)
        if gated is not None and rule.action == "redact":
            made = F.when(gated, F.array().cast(FINDINGS)).otherwise(made)
        arrays.append(made)
        if rule.python:
            if places is None:
                raise ValueError(f"rule {rule.id} is in Python, which needs the places of with_places")
            arrays.append(_failures(places, rule, rank))
    if gated is not None:
        whole = F.struct(F.lit(0).alias("start"), F.octet_length(text).alias("end"), F.lit(len(own)).alias("rule_rank"), F.lit(SENSITIVE_ID).alias("rule_id"), text.alias("value"), F.lit("custom").alias("category"),
                         F.lit("redact").alias("action"), F.lit(1.0).alias("confidence"), F.lit("remote_pack").alias("origin"))
        arrays.append(F.when(gated & ~(F.lit(False) if gate_allow is None else gate_allow), F.array(whole)).otherwise(F.array().cast(FINDINGS)))
    every = F.sort_array(F.concat(*arrays)) if arrays else F.array().cast(FINDINGS)
    return F.when(F.octet_length(text) > 0, every).otherwise(F.array().cast(FINDINGS))


def _prepared(df: DataFrame, rules: Sequence[Rule], text: str, allowlist: Sequence[str], phase: str) -> tuple[DataFrame, dict[str, Column]]:
    if not needs_places(rules, allowlist, phase):
        return df, {}
    name = free_name("_places", df.columns)
    return with_places(df, rules, name, text, allowlist, phase), {"places": F.col(name)}


def with_findings(df: DataFrame, rules: Sequence[Rule] = BUILTIN, text: str = "text", name: str = "findings", allowlist: Sequence[str] = (), phase: str = "request", **more) -> DataFrame:
    """``df`` with its findings as an array; one projection, after an Arrow pass if there are many literals, and no shuffle. A column of that name is replaced."""
    rows, places = _prepared(df, rules, text, allowlist, phase)
    made = rows.withColumn(name, found(F.col(f"`{text}`"), rules, allowlist, phase, **places, **more))
    return made.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()], name)


def findings(df: DataFrame, rules: Sequence[Rule] = BUILTIN, text: str = "text", allowlist: Sequence[str] = (), phase: str = "request", budget: int | None = None) -> DataFrame:
    """``df`` without ``text``, a row for each finding: start, end, value, rule and rank columns."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != text]
    rows, places = _prepared(df, rules, text, allowlist, phase)
    made = found(F.col(f"`{text}`"), rules, allowlist, phase, budget, **places)
    return rows.select(*kept, F.explode(made).alias("_f")).select(*kept, "_f.*")
