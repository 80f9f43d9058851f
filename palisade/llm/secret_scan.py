"""Secrets by fixed patterns and by compression novelty.

Three base patterns find assignments, access keys and long hexadecimal runs. Beyond
them, every token-like run in a sensitive context (a name such as key, token or auth at
most ``CONTEXT_BEFORE`` characters before it) is a candidate, and so is, in a run that
holds such a name itself, what follows an equals sign (``AWS_SECRET_ACCESS_KEY=...``) and
every part of ``CANDIDATE_LEAST`` letters and digits that ``_``, ``-`` or ``/`` joins to
the name. Only the start of a candidate must be near the name, it ends where the run or
the part ends. Zstandard, primed with a dictionary of common
identifiers, tells how many bytes the run adds to some code and prose and the text around
it, whose letters cost less than random ones. A run that costs as many bits as its
alphabet allows (``NOVEL_SHARE`` of what its kinds of characters can hold, a little more
for short ones) is reported as ``novel``, also where it stands twice; identifiers, paths,
words and what repeats parts of itself or of what stands nearby cost less and are not.

Spans are (kind, start, end) in code points, end exclusive, over whole texts; a novel
span never overlaps a base span. Defined cases: a null text counts as empty; equal texts
give equal spans; input columns that clash with output columns are replaced; an empty
table gives no rows; repeated rows and null ids are scanned like others; time grows with
the text, not with the number of names in it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import map_rows

# The base patterns, their least lengths and their order.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

HEX_RUN = re.compile(r"[0-9a-f]{24,}")
CANDIDATE_LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_LEAST)
INNER = re.compile(r"=+|(?<=[_/-])[A-Za-z0-9+]{%d,}" % CANDIDATE_LEAST)
ALPHABETS = ((re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[0-9]"), 10), (re.compile("[+/_=-]"), 5))
NARROW = ((re.compile("[0-9a-f]+"), 16), (re.compile("[0-9A-F]+"), 16))
CONTEXT = re.compile(r"(?:key|token|secret|passw|pwd|auth|bearer|credential|private|signature|session)", re.I | re.A)
CONTEXT_BEFORE, AROUND = 40, 256
NOVEL_SHARE, NOVEL_MORE = 0.96, 2.0
IDENTIFIERS = " ".join("""
    abstract account address algorithm application argument array async attribute authorization await base64 boolean
    buffer certificate channel class client collection config configuration connection constant constructor content
    context controller credential database default definition description destination directory document element
    endpoint environment exception execute export extends factory false final function handler header identifier
    implementation import include index instance integer interface internal iterator keyword length library listener
    localhost manager message metadata method module namespace network number object operation option override package
    parameter password pattern platform pointer private process production property protected protocol provider public
    reference register repository request resource response result return schema secret security sequence server service
    session signature source static status storage stream string structure subscription system template thread timeout
    timestamp token transaction transform transport undefined update username validate value variable vector version
    virtual volume warning window workspace abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
""".split())

# What the compressor has seen before the text around a candidate, so that it knows the letters of code and prose.
SEEN = """if value is None or len(rows) == 0: return False  # nothing to do here, the caller goes on with the next one; for (int i = 0; i < size; i++) { total += items[i].price * 1.07; }
The quick brown fox jumps over the lazy dog while 3 judges watch. See https://www.example.org/docs/page7?lang=en&sort=2 for how it works, then run: make all && ./run.sh --level=9 -o out/Result_2.txt
"""


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns: leftmost, non-overlapping per kind, long enough."""
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), "hex", m.end()) for m in HEX_RUN.finditer(text)]  # maximal runs of at least the least length
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Compressed bytes that ``candidate`` adds to the text around it, given the identifiers."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False)
    return len(press.compress(f"{SEEN}{before}{candidate}{after}".encode())) - len(press.compress(f"{SEEN}{before}{after}".encode()))


def capacity(run: str) -> float:
    """Bytes that a character of the run's alphabet can hold: its kinds of characters, or hexadecimal ones alone."""
    size = next((n for kind, n in NARROW if kind.fullmatch(run)), None) or sum(n for kind, n in ALPHABETS if kind.search(run))
    return math.log2(size) / 8


def is_novel(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` costs nearly all that its alphabet can hold beside what stands around it."""
    run = text[start:end]
    if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
        return False
    least = NOVEL_SHARE * len(run) + min(NOVEL_MORE, (1.04 - NOVEL_SHARE) * len(run))  # short runs must cost a little more
    # a secret that is written twice is one all the same
    before, after = (x.replace(run, "") for x in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
    return marginal_bytes(run, before, after) >= least * capacity(run)


def candidates(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Bounds of what may be a secret in the run ``text[start:end]``, the longest first."""
    if CONTEXT.search(text, max(0, start - CONTEXT_BEFORE), start):
        yield start, end
    for m in INNER.finditer(text, start, end):
        at = m.end() if text[m.start()] == "=" else m.start()
        if CONTEXT.search(text, max(start, at - CONTEXT_BEFORE), at):
            yield at, end if text[m.start()] == "=" else m.end()


def novel_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """(start, "novel", end) of incompressible runs in a sensitive context outside ``base``."""
    found: list[tuple[int, str, int]] = []
    held = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))
    for run in CANDIDATE.finditer(text):
        for start, end in candidates(text, *run.span()):
            if end - start < CANDIDATE_LEAST or (found and start < found[-1][2]):
                continue
            before = bisect_left(held, end)  # base spans that start before it ends
            if before and reach[before - 1] > start:
                continue
            if is_novel(text, start, end):
                found.append((start, "novel", end))
    return found


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and all spans of a text, each by start, then kind."""
    base = base_spans(text or "")
    novel = novel_spans(text or "", base) if text else []
    return base, sorted(base + novel, key=lambda x: (x[0], KINDS.index(x[1])))


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``secrets``, an array of (kind, start, end) by start."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

    def make(part: pa.RecordBatch):
        return ([[{"kind": k, "start": a, "end": b} for a, k, b in scan(t)[1]] for t in part.column("s0").to_pylist()],)

    return map_rows(df, [c for c in df.columns if c != "secrets"], [text], {"secrets": kind}, make)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""

    def make(part: pa.RecordBatch):
        rows = [scan(t) for t in part.column("s0").to_pylist()]
        counts = [[sum(s[1] == k for s in base) for base, _ in rows] for k in KINDS[:3]]
        return *counts, [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], [listed(every) for _, every in rows]

    long, string = T.LongType(), T.StringType()
    return map_rows(docs, ["doc_id"], ["text"], {"n_assign": long, "n_access": long, "n_hex": long, "base_sha256": string, "spans": string}, make)


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """``text`` with every span replaced, overlapping spans as one."""
    if not text:
        return text
    out, at = [], 0
    for a, _, b in scan(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` brought up to date; other columns and their order stay."""

    def make(part: pa.RecordBatch):
        return ([redacted(t) for t in part.column("s0").to_pylist()],)

    made = map_rows(docs, [c for c in docs.columns if c != "text"], ["text"], {"text": T.StringType()}, make)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])
