"""Patterns of rules, which have RE2's syntax and meaning, as Java patterns of the same meaning.

A pattern is parsed to a tree and refused where RE2 refuses it. The Java pattern is made
from the tree alone: every class is spelled as code points, every anchor by what it looks
at, and every group without a number, so that nothing depends on what a construct means
to Java. Matching is leftmost-first in both.

Not taken although RE2 takes it: a pattern that can match an empty text somewhere (rules
report no empty spans, but cutting a text at its matches would differ), groups nested more
than 100 deep, and a negated property within a class that ignores case. RE2 takes time in
proportion to the text; Java tries alternatives in turn, which nested repetitions of the
same characters make slow.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

LAST = 0x10FFFF
MOST_REPEATS, DEEPEST = 1000, 100
Ranges = tuple[tuple[int, int], ...]


class PatternError(ValueError):
    """A pattern that is not taken."""


# Classes of the syntax, as inclusive ranges of code points.
DIGIT: Ranges = ((0x30, 0x39),)
SPACE: Ranges = ((0x09, 0x0A), (0x0C, 0x0D), (0x20, 0x20))
WORD: Ranges = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A))
POSIX: dict[str, Ranges] = {
    "alnum": ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)),
    "alpha": ((0x41, 0x5A), (0x61, 0x7A)),
    "ascii": ((0x00, 0x7F),),
    "blank": ((0x09, 0x09), (0x20, 0x20)),
    "cntrl": ((0x00, 0x1F), (0x7F, 0x7F)),
    "digit": DIGIT,
    "graph": ((0x21, 0x7E),),
    "lower": ((0x61, 0x7A),),
    "print": ((0x20, 0x7E),),
    "punct": ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "space": ((0x09, 0x0D), (0x20, 0x20)),
    "upper": ((0x41, 0x5A),),
    "word": WORD,
    "xdigit": ((0x30, 0x39), (0x41, 0x46), (0x61, 0x66)),
}
CONTROL = {"a": 0x07, "f": 0x0C, "t": 0x09, "n": 0x0A, "r": 0x0D, "v": 0x0B}
CATEGORIES = ("C", "Cc", "Cf", "Co", "Cs", "L", "Ll", "Lm", "Lo", "Lt", "Lu", "M", "Mc", "Me", "Mn", "N", "Nd", "Nl", "No", "P", "Pc", "Pd", "Pe", "Pf", "Pi", "Po", "Ps", "S", "Sc", "Sk", "Sm", "So", "Z", "Zl", "Zp", "Zs")


@dataclass(frozen=True)
class Class:
    """A set of code points: ranges and (negated, property) pairs, or all others."""

    ranges: Ranges = ()
    properties: tuple[tuple[bool, str], ...] = ()
    negated: bool = False


@dataclass(frozen=True)
class Assertion:
    kind: str  # text start, text end, line start, line end, word boundary, no word boundary


@dataclass(frozen=True)
class Sequence:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Choice:
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Repeat:
    part: Node
    least: int
    most: int | None
    lazy: bool


Node = Class | Assertion | Sequence | Choice | Repeat


def union(ranges: Iterable[tuple[int, int]]) -> Ranges:
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return tuple((a, z) for a, z in out)


def complement(ranges: Iterable[tuple[int, int]]) -> Ranges:
    out, at = [], 0
    for a, z in union(ranges):
        if a > at:
            out.append((at, a - 1))
        at = z + 1
    return (*out, (at, LAST)) if at <= LAST else tuple(out)


def _simple(c: str) -> str:
    """The simple case folding of a character."""
    for folded in (c.casefold(), c.lower()):
        if len(folded) == 1:
            return folded
    return c


@cache
def orbits() -> dict[int, tuple[int, ...]]:
    """The other code points that a code point equals when case does not count, where there are any."""
    groups: dict[str, list[int]] = {}
    for i in range(LAST + 1):
        if not 0xD800 <= i < 0xE000 and ((c := chr(i)).casefold() != c or c.upper() != c):
            for x in {c, _simple(c)}:
                groups.setdefault(_simple(x), []).append(ord(x))
    out = {}
    for own in groups.values():
        each = sorted(set(own))
        if len(each) > 1:
            out |= {i: tuple(x for x in each if x != i) for i in each}
    return out


def has_property(name: str, code: int) -> bool:
    if name in CATEGORIES:
        return unicodedata.category(chr(code)).startswith(name)
    import regex

    return regex.fullmatch(rf"\p{{Script={name}}}", chr(code)) is not None


def folded(c: Class) -> Class:
    """A class with all that its members equal when case does not count; not to be called on negated ones."""
    more = []
    for code, others in orbits().items():
        for x in others:
            if any(a <= x <= z for a, z in c.ranges) or any(has_property(p, x) != negated for negated, p in c.properties):
                more.append((code, code))
                break
    return Class(union([*c.ranges, *more]), c.properties)


def property_class(name: str, negated: bool) -> Class:
    if name.startswith("^"):
        name, negated = name[1:], not negated
    if name == "Any":
        return Class(((0, LAST),), (), negated)
    if name not in CATEGORIES:
        import regex

        try:
            known = re.fullmatch(r"[A-Z][a-z]+(_[A-Z][a-z]+)*|Nko|SignWriting", name) and regex.compile(rf"\p{{Script={name}}}")
        except regex.error:
            known = None
        if not known:
            raise PatternError(f"invalid character class range: {name}")
    return Class((), ((False, name),), negated)


class _Parser:
    def __init__(self, pattern: str):
        self.text, self.at, self.depth = pattern, 0, 0
        self.flags = frozenset()
        self.names: set[str] = set()

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        self.at += n
        return out

    def choice(self) -> Node:
        self.depth += 1
        if self.depth > DEEPEST:
            raise PatternError("expression nests too deeply")
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        self.depth -= 1
        return parts[0] if len(parts) == 1 else Choice(tuple(parts))

    def sequence(self) -> Node:
        parts: list[Node] = []
        repeated = False  # whether the last part ends in a repetition of its own
        while self.at < len(self.text) and self.peek() not in "|)":
            c = self.peek()
            if self.peek(2) == "\\Q":
                # a repetition after it goes to its last character only
                end = self.text.find("\\E", self.at + 2)
                parts += [self.literal(ord(x)) for x in self.text[self.at + 2 : end if end >= 0 else len(self.text)]]
                self.at, repeated = end + 2 if end >= 0 else len(self.text), False
                continue
            counted = re.match(r"\{(0|[1-9]\d*)(?:(,)(0|[1-9]\d*)?)?\}", self.text[self.at :], re.ASCII) if c == "{" else None
            if c in "*+?" or counted:
                if not parts:
                    raise PatternError(f"missing argument to repetition operator: {c}")
                if repeated:
                    raise PatternError("invalid nested repetition operator")
                if counted:
                    least = int(counted[1])
                    most = least if not counted[2] else int(counted[3]) if counted[3] else None
                    if least > MOST_REPEATS or (most is not None and (most > MOST_REPEATS or most < least)):
                        raise PatternError(f"invalid repeat count: {counted[0]}")
                    self.take(len(counted[0]))
                else:
                    least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[self.take()]
                lazy = self.peek() == "?"
                if lazy:
                    self.take()
                node = Repeat(parts.pop(), least, most, lazy != ("U" in self.flags))
                if _repeats(node) > MOST_REPEATS:
                    raise PatternError("invalid repeat count: repetitions multiply")
                parts.append(node)
                repeated = True
                continue
            made = self.atom()
            if made is not None:  # flags for what follows are no part
                parts.append(made)
            repeated = False
        return parts[0] if len(parts) == 1 else Sequence(tuple(parts))

    def literal(self, code: int) -> Class:
        one = Class(((code, code),))
        return folded(one) if "i" in self.flags else one

    def atom(self) -> Node | None:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket()
        if c == ".":
            return Class(((0, LAST),)) if "s" in self.flags else Class(((0x0A, 0x0A),), (), True)
        if c == "^":
            return Assertion("line start" if "m" in self.flags else "text start")
        if c == "$":
            return Assertion("line end" if "m" in self.flags else "text end")
        if c == "\\":
            return self.escape()
        return self.literal(ord(c))

    def group(self) -> Node | None:
        outer = self.flags
        if self.peek() == "?":
            named = re.match(r"\?P?<([^>]*)>", self.text[self.at :])
            if named and not re.match(r"\?<[=!]", self.text[self.at :]):
                if not re.fullmatch(r"[0-9A-Za-z_]+", named[1]) or named[1] in self.names:
                    raise PatternError(f"invalid or duplicate capture group name: {named[1]}")
                self.names.add(named[1])
                self.take(len(named[0]))
            else:
                found = re.match(r"\?([imsU]*)(-[imsU]+)?([:)])", self.text[self.at :])
                if not found:
                    raise PatternError("invalid or unsupported Perl syntax")
                self.take(len(found[0]))
                self.flags = (self.flags | set(found[1])) - set(found[2] or "")
                if found[3] == ")":
                    return None
        inner = self.choice()
        if self.take() != ")":
            raise PatternError("missing closing )")
        self.flags = outer
        # a group is a part of its own, whatever stands in it
        return Sequence((inner,))

    def code(self) -> int | None:
        """A code point after a backslash, if it stands for one."""
        c = self.peek()
        if c in CONTROL:
            self.take()
            return CONTROL[c]
        octal = re.match(r"0[0-7]{0,2}|[1-7][0-7]{1,2}", self.text[self.at :])
        if octal:
            self.take(len(octal[0]))
            return int(octal[0], 8)
        if c == "x":
            found = re.match(r"x(?:([0-9A-Fa-f]{2})|\{([0-9A-Fa-f]+)\})", self.text[self.at :])
            code = int(found[1] or found[2], 16) if found else LAST + 1
            if code > LAST:
                raise PatternError("invalid escape sequence: \\x")
            self.take(len(found[0]))
            return code
        if c and c.isascii() and not c.isalnum():
            self.take()
            return ord(c)
        return None

    def perl(self) -> Class | None:
        """A class after a backslash, if it stands for one."""
        c = self.peek()
        if c and c in "dDsSwW":
            self.take()
            plain = Class({"d": DIGIT, "s": SPACE, "w": WORD}[c.lower()])
            plain = folded(plain) if "i" in self.flags else plain
            return plain if c.islower() else Class(complement(plain.ranges))
        if c and c in "pP":
            found = re.match(r"[pP](?:\{([^}]*)\}|(.))", self.text[self.at :], re.S)
            if not found:
                raise PatternError("invalid character class range")
            self.take(len(found[0]))
            made = property_class(found[1] if found[1] is not None else found[2], c == "P")
            if "i" in self.flags and made.properties:
                wide = folded(Class(made.ranges, made.properties))
                made = Class(wide.ranges, wide.properties, made.negated)
            return made
        return None

    def escape(self) -> Node:
        c = self.peek()
        simple = {"A": "text start", "z": "text end", "b": "word boundary", "B": "no word boundary"}
        if c in simple and c:
            self.take()
            return Assertion(simple[c])
        found = self.perl()
        if found is not None:
            return found
        code = self.code()
        if code is None:
            raise PatternError(f"invalid escape sequence: \\{c}" if c else "trailing backslash at end of expression")
        return self.literal(code)

    def bracket(self) -> Class:
        negated = self.peek() == "^"
        if negated:
            self.take()
        ranges: list[tuple[int, int]] = []
        properties: list[tuple[bool, str]] = []
        first = True
        while self.peek() != "]" or first:
            if self.at >= len(self.text):
                raise PatternError("missing closing ]")
            first = False
            posix = re.match(r"\[:(\^?)(.*?):\]", self.text[self.at :], re.S)
            if posix:
                if posix[2] not in POSIX:
                    raise PatternError(f"invalid character class range: {posix[0]}")
                self.take(len(posix[0]))
                own = Class(POSIX[posix[2]])
                own = folded(own).ranges if "i" in self.flags else own.ranges
                ranges += complement(own) if posix[1] else own
                continue
            if self.peek() == "\\":
                self.take()
                found = self.perl()
                if found is not None:
                    if not found.properties:
                        ranges += complement(found.ranges) if found.negated else found.ranges
                    elif not found.negated:
                        ranges += found.ranges
                        properties += found.properties
                    elif not found.ranges:
                        properties += [(not n, p) for n, p in found.properties]
                    else:
                        raise PatternError("a negated property that ignores case stands in a class")
                    continue
                low = self.code()
                if low is None:
                    raise PatternError("invalid escape sequence in a class")
            else:
                low = ord(self.take())
            high = low
            if self.peek() == "-" and self.peek(2) != "-]" and self.at + 1 < len(self.text):
                self.take()
                if self.peek() == "\\":
                    self.take()
                    high = self.code()
                    if high is None:
                        raise PatternError("invalid escape sequence in a class")
                else:
                    high = ord(self.take())
                if high < low:
                    raise PatternError("invalid character class range")
            own = Class(((low, high),))
            ranges += folded(own).ranges if "i" in self.flags else own.ranges
        self.take()
        return Class(union(ranges), tuple(properties), negated)


def _repeats(node: Node) -> int:
    """How often counted repetitions within a node multiply."""
    if isinstance(node, Sequence | Choice):
        return max((_repeats(p) for p in node.parts), default=1)
    if isinstance(node, Repeat):
        own = max(node.least, node.most or 0, 1) if node.most != 1 else 1
        return own * _repeats(node.part)
    return 1


def least(node: Node) -> int:
    """The characters that the shortest match has."""
    if isinstance(node, Class):
        return 1
    if isinstance(node, Sequence):
        return sum(map(least, node.parts))
    if isinstance(node, Choice):
        return min(map(least, node.parts))
    if isinstance(node, Repeat):
        return node.least * least(node.part)
    return 0


def parse(pattern: str) -> Node:
    """The tree of a pattern."""
    parser = _Parser(pattern)
    out = parser.choice()
    if parser.at < len(pattern):
        raise PatternError("unexpected )")
    return out


_IN, _OUT = "[0-9A-Za-z_]", "[^0-9A-Za-z_]"
ASSERTIONS = {
    "text start": r"\A",
    "text end": r"\z",
    "line start": r"(?:\A|(?<=\n))",
    "line end": r"(?:\z|(?=\n))",
    "word boundary": rf"(?:(?<={_IN})(?!{_IN})|(?<!{_IN})(?={_IN}))",
    "no word boundary": rf"(?:(?<={_IN})(?={_IN})|(?<!{_IN})(?!{_IN}))",
}


def _side(node: Node, last: bool) -> bool | None:
    """Whether the first (or last) character of all matches is a word character; None where that is not told, or where there may be none."""
    if isinstance(node, Class):
        own = _plain(node)
        return None if not own else True if not _meet(own, complement(WORD)) else False if not _meet(own, WORD) else None
    if isinstance(node, Sequence):
        return _side(node.parts[-1 if last else 0], last) if node.parts else None
    if isinstance(node, Choice):
        every = {_side(p, last) for p in node.parts}
        return every.pop() if len(every) == 1 else None
    return _side(node.part, last) if isinstance(node, Repeat) and node.least else None


def _plain(c: Class) -> Ranges | None:
    """The code points of a class without properties."""
    return None if c.properties else complement(c.ranges) if c.negated else union(c.ranges)


def _meet(a: Ranges, b: Ranges) -> bool:
    return any(x[0] <= y[1] and y[0] <= x[1] for x in a for y in b)


def _boundary(kind: str, before: Node | None, after: Node | None) -> str:
    """A word boundary, or none, of which one side is known: only the other is looked at."""
    differs = kind == "word boundary"
    side = None if before is None else _side(before, True)
    if side is not None:
        return f"(?{'=' if side != differs else '!'}{_IN})"
    side = None if after is None else _side(after, False)
    return ASSERTIONS[kind] if side is None else f"(?<{'=' if side != differs else '!'}{_IN})"


def _keeps(own: Ranges, some: bool, after: tuple[Node, ...]) -> bool:
    """Whether nothing that follows a repetition can begin with one of its characters, so that giving some back never helps; ``some`` tells whether it keeps one at least."""
    for node in after:
        if isinstance(node, Assertion):
            word = not _meet(own, complement(WORD)) or not _meet(own, WORD)
            return node.kind == "text end" or (node.kind == "line end" and not _meet(own, ((0x0A, 0x0A),))) or (node.kind == "word boundary" and some and word)
        part = node.part if isinstance(node, Repeat) else node
        ranges = _plain(part) if isinstance(part, Class) else None
        if ranges is None or _meet(own, ranges):
            return False
        if not isinstance(node, Repeat) or node.least:
            return True
    return False


def _code(i: int) -> str:
    return chr(i) if chr(i).isascii() and chr(i).isalnum() else rf"\x{{{i:X}}}"


def emit(node: Node, after: tuple[Node, ...] = ()) -> str:
    """A Java pattern that matches what the tree matches; ``after`` is what follows it."""
    if isinstance(node, Class):
        if len(node.ranges) == 1 and node.ranges[0][0] == node.ranges[0][1] and not node.properties and not node.negated:
            return _code(node.ranges[0][0])
        if not node.ranges and not node.properties:
            return r"[\x{0}-\x{10FFFF}]" if node.negated else r"(?!)"
        plain, negated = _plain(node), node.negated
        if plain:
            negated = plain[-1][1] == LAST
        # Java looks characters below 256 up in a table if they are spelled one by one
        ranges = node.ranges if plain is None else complement(plain) if negated else plain
        single = lambda a, z: z < 256 and plain is not None
        inner = "".join("".join(map(_code, range(a, z + 1))) if a == z or single(a, z) else f"{_code(a)}-{_code(z)}" for a, z in ranges)
        inner += "".join(rf"\{'P' if n else 'p'}{{{p if p in CATEGORIES else f'Is{p}'}}}" for n, p in node.properties)
        return f"[{'^' * negated}{inner}]" if inner else r"[\x{0}-\x{10FFFF}]" if negated else r"(?!)"
    if isinstance(node, Assertion):
        return ASSERTIONS[node.kind]
    if isinstance(node, Sequence):
        out = []
        for i, p in enumerate(node.parts):
            if isinstance(p, Assertion) and p.kind.endswith("word boundary"):
                out.append(_boundary(p.kind, node.parts[i - 1] if i else None, node.parts[i + 1] if i + 1 < len(node.parts) else None))
            else:
                out.append(f"(?:{emit(p)})" if isinstance(p, Choice) else emit(p, (*node.parts[i + 1 :], *after)))
        return "".join(out)
    if isinstance(node, Choice):
        return "|".join(map(emit, node.parts))
    times = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((node.least, node.most)) or (f"{{{node.least}}}" if node.most == node.least else f"{{{node.least},{'' if node.most is None else node.most}}}")
    own = _plain(node.part) if isinstance(node.part, Class) else None
    part = emit(node.part)
    mode = "?" if node.lazy else "+" if own and _keeps(own, node.least > 0, after) else ""
    return f"{part if isinstance(node.part, Class) and part != '(?!)' else f'(?:{part})'}{times}{mode}"


def _musts(node: Node) -> list[str]:
    """Characters without which there is no match."""
    if isinstance(node, Class):
        own = _plain(node)
        return [chr(own[0][0])] if own and len(own) == 1 and own[0][0] == own[0][1] and not 0xD800 <= own[0][0] < 0xE000 else []
    if isinstance(node, Sequence):
        return [x for p in node.parts for x in _musts(p)]
    return _musts(node.part) if isinstance(node, Repeat) and node.least else []


@cache
def needed(pattern: str) -> str | None:
    """A character without which a pattern has no match, a rarer one if there are several."""
    return min(_musts(parse(pattern)), key=lambda c: c.isspace() * 3 + c.islower() * 2 + (c in ".,"), default=None)


@cache
def java(pattern: str) -> str:
    """The Java pattern of a rule's pattern, which never matches an empty text."""
    tree = parse(pattern)
    if least(tree) == 0:
        raise PatternError("the pattern can match an empty text")
    return emit(tree)
