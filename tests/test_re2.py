"""Patterns of rules: what is taken, what they match, against RE2 itself (DuckDB's) and a plain matcher on the tree."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from palisade.functions import re2
from palisade.functions.spans import matches
from palisade.operators.detectors import regex_rule
from palisade.plans.rules import RuleError, compile_document

TEXTS = ["", "a", "b\n", "end", "end\n", "end\nend", "a\rb", "a\nb", "x\x0by z", "abc ABC", "kKK sſS", "é É ß ẞ", "ab1_ 22", "(a.b)*", "a]-^b", "Σσς", "𝒳a𝒳", "α中я ९", "a" * 12, "aab\tab", "foo bar\n\nbaz foo", "\\d{3} x{2}", "x y", "foobar foo"]


def ends(node, text, at):
    """Where a match that starts at ``at`` may end, the preferred first."""
    if isinstance(node, re2.Class):
        inside = at < len(text) and (any(a <= ord(text[at]) <= z for a, z in node.ranges) or any(re2.has_property(p, ord(text[at])) != n for n, p in node.properties))
        return [at + 1] if at < len(text) and inside != node.negated else []
    if isinstance(node, re2.Assertion):
        word = [0 <= i < len(text) and text[i].isascii() and (text[i].isalnum() or text[i] == "_") for i in (at - 1, at)]
        holds = {"text start": at == 0, "text end": at == len(text), "line start": at == 0 or text[at - 1] == "\n", "line end": at == len(text) or text[at] == "\n", "word boundary": word[0] != word[1], "no word boundary": word[0] == word[1]}
        return [at] if holds[node.kind] else []
    if isinstance(node, re2.Sequence):
        found = [at]
        for part in node.parts:
            found = list(dict.fromkeys(e for f in found for e in ends(part, text, f)))
        return found
    if isinstance(node, re2.Choice):
        return list(dict.fromkeys(e for p in node.parts for e in ends(p, text, at)))
    if node.least:
        rest = re2.Repeat(node.part, node.least - 1, None if node.most is None else node.most - 1, node.lazy)
        return list(dict.fromkeys(e for f in ends(node.part, text, at) for e in ends(rest, text, f)))
    if node.most == 0:
        return [at]
    rest = re2.Repeat(node.part, 0, None if node.most is None else node.most - 1, node.lazy)
    more = [e for f in ends(node.part, text, at) if f > at for e in ends(rest, text, f)]
    return list(dict.fromkeys([at, *more] if node.lazy else [*more, at]))


def plain(pattern, text):
    tree, at, out = re2.parse(pattern), 0, []
    while at <= len(text):
        found = ends(tree, text, at)
        if found and found[0] > at:
            out.append((len(text[:at].encode()), len(text[: found[0]].encode()), text[at : found[0]]))
            at = found[0]
        else:
            at += 1
    return out


def of_spark(spark, patterns, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    rows = df.select("i", *[matches(F.col("t"), re2.java(p)).alias(f"p{k}") for k, p in enumerate(patterns)]).orderBy("i").collect()
    return [[[tuple(s) for s in r[f"p{k}"]] for r in rows] for k in range(len(patterns))]


TAKEN = [r"end$", r"^end", r"(?m)end$", r"(?m)^b.*$", r"a.b", r"(?s)a.b", r"\s+", r"\S+", r"[a-z&&[^b]]", r"[a-z&&[^b]+", r"\pN+", r"\p{N}", r"\PL", r"\p{Greek}+", r"\p{^Greek}", r"[\p{Lu}b]+", r"[^\P{Ll}]", r"(?P<n>a)b?", r"(?<n>a)", r"a\z", r"\Aa", r"\Qa.b\E\)", r"\Qab\E+", r"(?i)x(?-i)y|(?i:ABC)",
         r"(?i)k+", r"(?i)S+", r"(?i)[k-s]+", r"(?i)[^k]", r"(?i)ß", r"(?i)σ+", r"(?i)\w+", r"(?i)\W", r"(?i)\p{Lu}+", r"(?i)\P{Lu}", r"\bfoo\b", r"\Bo+", r"[[:alpha:]]+", r"[[:^alpha:]]+", r"[]a-]+", r"[^]a]+", r"[a-c-e]+", r"a{2}", r"a{2,}?", r"a{2,3}", r"x{2}|\{3}", r"a{,5}", r"a{01}|\\d\{", r"(?U)a+", r"(?U)a+?", r"a+?b",
         r"(a|ab)(c|bc)?", r"(?:a*b|a)+", r"\x61\x{62}", r"\x{1D4B3}", r"\141", r"[\x{61}-\x{63}\d]", r"\.", r"\_", r"\-", r"[\n\t]", r"a(?i)*b", r"(?)a", r"(|a)b", r"é|É", r"\d+|[^\D1]", r"x\x{2028}y", r".", r"[^a]", r"(?s:.)", r"foo(?:bar)??", r"[\w.]+", r"(?:^|b)a", r"o(?m:$)"]
REFUSED = [r"(?>a+)b", r"a++", r"a**", r"*a", r"a|*", r"(?=a)b", r"(?<=a)b", r"(?!a)b", r"\1a", r"(a)\1", r"\Z", r"\h", r"\8", r"a{2,1}", r"a{1001}", r"(a{50}){50}", r"[b-a]", r"[a", r"(a", r"a)", "a\\", r"\x{110000}", r"\xg", r"[[:foo:]]", r"\p{Foo}", r"\pX", r"(?P<n>a)(?P<n>b)", r"(?P<>a)", r"(?P=n)", r"(?z)a", r"(?i-)a", r"\C", r"[\b]", r"\G", r"\R"]


def test_what_is_taken():
    con = duckdb.connect()
    for p in TAKEN:
        re2.java(p)
        con.execute("SELECT regexp_matches('x', ?)", [p.replace("(?<n>", "(?P<n>")])
    for p in REFUSED:
        with pytest.raises(re2.PatternError):
            re2.java(p)
    for p in ("", "a*", "a|", r"\b", "^", "(a?)*", r"$", "(?:)"):
        with pytest.raises(re2.PatternError):
            re2.java(p)


def test_equals_re2(spark):
    con = duckdb.connect()
    got = of_spark(spark, TAKEN, TEXTS)
    for p, own in zip(TAKEN, got, strict=True):
        for t, spans in zip(TEXTS, own, strict=True):
            want = con.execute("SELECT regexp_extract_all(?, ?)", [t, "(?-s)" + p.replace("(?<n>", "(?P<n>")]).fetchone()[0]
            assert [s[2] for s in spans] == [w for w in want if w], (p, t)
            assert spans == plain(p, t), (p, t)


def made_up(rng, depth=3):
    kind = rng.randrange(12 if depth else 5)
    if kind < 3:
        return rng.choice(["a", "b", "c", r"\n", "é", r"\d", r"\w", ".", "[ab]", "[^a]", r"[^\w]", r"\s", "(?i:A)", r"\p{L}", "1"])
    if kind < 5:
        return rng.choice([r"\b", "^", "$", "(?m:^)", "(?m:$)", r"\B", "a", "b"])
    if kind < 8:
        return made_up(rng, depth - 1) + made_up(rng, depth - 1)
    if kind < 10:
        return f"(?:{made_up(rng, depth - 1)}|{made_up(rng, depth - 1)})"
    return f"(?:{made_up(rng, depth - 1)}){rng.choice(['*', '+', '?', '*?', '+?', '??', '{2}', '{1,2}', '{0,2}?'])}"


def test_made_up_patterns(spark):
    rng, patterns = random.Random(11), []
    while len(patterns) < 60:
        p = made_up(rng)
        try:
            re2.java(p)
        except re2.PatternError:
            continue
        patterns.append(p)
    texts = ["".join(rng.choices("aabbc1é \n", k=rng.randrange(9))) for _ in range(60)]
    con = duckdb.connect()
    for p, own in zip(patterns, of_spark(spark, patterns, texts), strict=True):
        for t, spans in zip(texts, own, strict=True):
            assert spans == plain(p, t), (p, t)
            assert [s[2] for s in spans] == [w for w in con.execute("SELECT regexp_extract_all(?, ?)", [t, f"(?-s){p}"]).fetchone()[0] if w], (p, t)


def test_rules():
    with pytest.raises(re2.PatternError):
        regex_rule("x", "(?=a)")
    document = '{"schema_version": 1, "rules": [{"id": "r", "type": "regex", "action": "warn", "pattern": %s}]}'
    assert compile_document(document % r'"(?P<n>a)\\z"').rules[0].id == "r"
    for bad in (r'"a++"', '""', '"a*"', f'"{"a" * 1025}"'):
        with pytest.raises(RuleError):
            compile_document(document % bad)
