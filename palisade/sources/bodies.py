"""JSON bodies as a leaf relation: one row per string value, with its place in the raw bytes.

The walk is iterative, strict and byte-exact: duplicate keys give a row each, values that
are themselves JSON are walked in turn, and a body with any error gives one error row and
no leaf.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.memory import give_back

# Limits of nesting, of JSON within JSON, and of identities.
MOST_DEPTH, MOST_ENCODED, MOST_IDENTITY = 10_000, 32, 1024
UNIT = "\x1f"

_WORD = re.compile(
    rb'[ \t\n\r]*(?:([{}\[\]:,])|"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"'
    rb"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))")
_BLANK = re.compile(rb"[ \t\n\r]*")
_ESCAPE = re.compile(rb"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\\x80-\xff]|[\xc0-\xff][\x80-\xbf]*")
_SHORT = {b'\\"': b'"', b"\\\\": b"\\", b"\\/": b"/", b"\\b": b"\b", b"\\f": b"\f", b"\\n": b"\n", b"\\r": b"\r", b"\\t": b"\t"}


# Rows and bytes that a Python worker takes from Arrow at a time.
PART_ROWS, PART_BYTES = 256, 1 << 20


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches halved into parts of so many rows and bytes (a row at least), so that what Python makes of them does not grow with the batch; freed memory is handed back at the end."""
    try:
        for batch in batches:
            left = [batch] if batch.num_rows else []
            while left:
                part = left.pop()
                if part.num_rows > 1 and (part.num_rows > PART_ROWS or part.nbytes > PART_BYTES):
                    half = part.num_rows // 2
                    left += [part.slice(half), part.slice(0, half)]
                else:
                    yield part
            pa.default_memory_pool().release_unused()
    finally:
        give_back()


class WalkError(ValueError):
    """A body that cannot be walked; the argument names the reason."""


@dataclass
class Leaf:
    path: str
    value: bytes
    key: str | None
    chain: tuple[tuple[bytes, int], ...]  # raw interiors and their opening quotes, innermost first
    scalars: str | None  # what stands before it, None if longer than an identity may be

    @property
    def encoded(self) -> bool:
        """Whether the value was decoded from JSON within JSON; at the limit of that it is not told apart."""
        return 1 < len(self.chain) <= MOST_ENCODED


def unit(raw: bytes) -> bytes:
    """The UTF-8 bytes that one escape or character stands for; a lone surrogate is U+FFFD."""
    if raw in _SHORT:
        return _SHORT[raw]
    if raw[:2] != b"\\u":
        return raw
    code = int(raw[2:6], 16)
    if len(raw) == 12:
        code = 0x10000 + ((code - 0xD800) << 10) + (int(raw[8:12], 16) - 0xDC00)
    return "�".encode() if 0xD800 <= code < 0xE000 else chr(code).encode()


def unescape(raw: bytes) -> bytes:
    return raw if b"\\" not in raw else b"".join(unit(m.group()) for m in _ESCAPE.finditer(raw))


def escape(value: bytes) -> bytes:
    """A JSON string's interior: quotes, backslashes and control bytes escaped, nothing else."""
    short = {v: k for k, v in _SHORT.items() if v != b"/"}
    return re.sub(rb'["\\\x00-\x1f]', lambda m: short.get(m.group(), b"\\u%04x" % m.group()[0]), value)


def raw_span(chain: tuple[tuple[bytes, int], ...], start: int, end: int) -> tuple[int, int]:
    """Byte range in the body of a byte range in a leaf's value, widened to whole units at each level."""
    for raw, opening in chain:
        at, low, high = 0, None, None
        for m in _ESCAPE.finditer(raw):
            size = len(unit(m.group()))
            if low is None and at + size > start:
                low = m.start()
            if at < end:
                high = m.end()
            at += size
        low = len(raw) if low is None else low
        start, end = opening + 1 + low, opening + 1 + (high if high is not None else low)
    return start, end


def _pointer(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _scan(body: bytes) -> Iterator[tuple[str, str | None, bytes, int, str | None]]:
    """(path, key, raw interior, opening quote, scalars before it) of each string value; scalars of objects go by name, of arrays by index."""
    stack: list[dict] = []
    size = 0  # bytes of all scalars that open frames hold
    at, want, done = 0, "value", False
    while not done:
        m = _WORD.match(body, at)
        if m is None:
            raise WalkError("malformed_json")
        mark, text, scalar = m.groups()
        at = m.end()
        frame = stack[-1] if stack else None
        if want in ("value", "value or ]") and (text is not None or scalar is not None or mark in (b"{", b"[")):
            path, key = "", None
            if frame:
                key = frame["key"] if frame["object"] else None
                path = frame["path"] + "/" + (_pointer(key) if frame["object"] else str(frame["index"]))
            if mark:
                if len(stack) >= MOST_DEPTH:
                    raise WalkError("max_depth")
                stack.append({"object": mark == b"{", "path": path, "key": None, "index": 0, "scalars": [], "size": 0})
                want = "key or }" if mark == b"{" else "value or ]"
                continue
            if text is not None:
                yield path, key, text, m.end() - len(text) - 2, UNIT.join(x for f in stack for x in f["scalars"]) if size <= MOST_IDENTITY else None
            elif frame:
                own = f"{key if frame['object'] else frame['index']}={scalar.decode()}"
                frame["size"] += len(own) + 1
                size += len(own) + 1
                if size <= MOST_IDENTITY:
                    frame["scalars"].append(own)
        elif want in ("key", "key or }") and text is not None:
            frame["key"] = unescape(text).decode()
            want = "colon"
            continue
        elif want == "colon" and mark == b":":
            want = "value"
            continue
        elif want == "comma" and mark == b"," and frame:
            frame["index"] += 1
            want = "key" if frame["object"] else "value"
            continue
        elif (mark == b"}" and frame and frame["object"] and want in ("key or }", "comma")) or (mark == b"]" and frame and not frame["object"] and want in ("value or ]", "comma")):
            size -= stack.pop()["size"]
        else:
            raise WalkError("malformed_json")
        want, done = "comma", not stack
    if _BLANK.fullmatch(body, at) is None:
        raise WalkError("trailing_data")


def walk(body: bytes, depth: int = 0, wrap: tuple[tuple[bytes, int], ...] = ()) -> list[Leaf]:
    """Every string value of ``body`` in document order."""
    try:
        body.decode()
    except UnicodeDecodeError:
        raise WalkError("invalid_utf8") from None
    leaves = []
    for path, key, raw, opening, scalars in _scan(body):
        value, chain = unescape(raw), ((raw, opening), *wrap)
        inner: list[Leaf] = []
        if depth < MOST_ENCODED and value[:1] in (b"{", b"[", b'"', b" ", b"\t", b"\n", b"\r"):
            try:
                inner = walk(value, depth + 1, chain)
            except WalkError:
                inner = []
        if inner:
            # a leaf's member name is that of its own document's innermost object, if it is in one
            leaves += [Leaf(path + x.path, x.value, x.key, x.chain, None if scalars is None or x.scalars is None else UNIT.join(s for s in (scalars, x.scalars) if s)) for x in inner]
        else:
            leaves.append(Leaf(path, value, key, chain, scalars))
    return leaves


def identity_of(leaf: Leaf, nth: int) -> str | None:
    """Path, scalars and occurrence; None if that is too long to tell leaves apart."""
    if leaf.scalars is None:
        return None
    made = UNIT.join([leaf.path, *([leaf.scalars] if leaf.scalars else []), str(nth)])
    return made if len(made.encode()) <= MOST_IDENTITY else None


def identities(found: list[Leaf]) -> list[str | None]:
    """The identity of each leaf of a body."""
    seen: dict[str, int] = {}
    out = []
    for x in found:
        seen[x.path] = nth = seen.get(x.path, -1) + 1
        out.append(identity_of(x, nth))
    return out


LEAF = T.StructType([
    T.StructField("leaf_index", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("value", T.StringType()), T.StructField("encoded", T.BooleanType()),
    T.StructField("member", T.BooleanType()), T.StructField("key", T.StringType()), T.StructField("identity", T.StringType()), T.StructField("identifiable", T.BooleanType()), T.StructField("error", T.StringType())])


def leaves(bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """``key`` and the leaf columns of every string value; a body that cannot be walked is one row with ``error``."""
    schema = T.StructType([bodies.schema[key], *LEAF.fields])

    def rows(raw: bytes | None):
        try:
            every = walk(bytes(raw or b""))
            for i, (x, identity) in enumerate(zip(every, identities(every), strict=True)):
                yield i, x.path, x.value.decode(), x.encoded, x.key is not None, x.key, identity, identity is not None, None
        except WalkError as e:
            yield (*[None] * 8, str(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keys, out = [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    made = list(rows(raw))
                except RecursionError:
                    made = [(*[None] * 8, "max_depth")]
                keys += [k] * len(made)
                out += made
                if len(out) > 20_000:
                    yield _batch(keys, out, schema, batch)
                    keys, out = [], []
            yield _batch(keys, out, schema, batch)

    return bodies.select(key, F.col(body).cast("binary").alias("body")).mapInArrow(run, schema)


def _batch(keys: list, rows: list, schema: T.StructType, like: pa.RecordBatch) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(keys, like.schema.field(0).type), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=schema.names)


def declares_json(content_type: Column, body: Column) -> Column:
    """A JSON media type, or without one a body that starts like JSON."""
    declared = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))) == "application/json"
    return F.coalesce(declared, F.ltrim(body.cast("string"), F.lit(" \t\r\n")).rlike(r'^[{\["]'), F.lit(False))


def within_cap(body: Column, cap: int) -> Column:
    """Whether a body is at most ``cap`` bytes; longer ones are refused, never cut."""
    return F.octet_length(F.coalesce(body, F.lit(b""))) <= cap


def identity_encoding(header: Column) -> Column:
    """Whether every content coding is ``identity``; no header is, a blank one is not."""
    return F.coalesce(F.forall(F.split(header, ","), lambda x: F.lower(F.trim(x)) == "identity"), F.lit(True))


def inflated(bodies: DataFrame, body: str = "body", encoding: str = "content_encoding", cap: int = 64 << 20) -> DataFrame:
    """``bodies`` with codings unwound from the last to the first, and ``refused`` where that fails or any step gives more than ``cap`` bytes."""

    def undo(raw: bytes | None, codings: str | None) -> bytes | None:
        out = raw or b""
        for coding in reversed([c for c in (x.strip().lower() for x in (codings or "").split(",")) if c not in ("", "identity")]):
            if coding not in ("gzip", "x-gzip", "deflate"):
                return None
            parts, left = [], out
            while left or not parts:
                try:
                    press = zlib.decompressobj(-15 if coding == "deflate" else 31)
                    parts.append(press.decompress(left, cap - sum(map(len, parts)) + 1))
                except zlib.error:
                    return None
                if not press.eof or sum(map(len, parts)) > cap:
                    return None
                # a gzip body is one or more members, to its end
                left = b"" if coding == "deflate" else press.unused_data
            out = b"".join(parts)
        return out

    schema = T.StructType([*(f for f in bodies.schema.fields if f.name not in (body, "refused")), T.StructField(body, T.BinaryType()), T.StructField("refused", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            made = [undo(b, e) for b, e in zip(batch.column(body).to_pylist(), batch.column(encoding).to_pylist(), strict=True)]
            kept = [batch.column(n) for n in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, pa.binary()), pa.array([m is None for m in made])], names=schema.names)

    return bodies.withColumn(body, F.col(body).cast("binary")).mapInArrow(run, schema)


def rewrite(body: bytes, edits: list[tuple[int, int, int, str]]) -> tuple[bytes, int]:
    """``body`` with (leaf, start, end, replacement) edits spelled at each leaf's depth; the first of overlapping edits wins."""
    found = walk(body)
    placed = sorted((*raw_span(found[i].chain, a, b), i, r) for i, a, b, r in edits if b > a)
    out, at, n = [], 0, 0
    for a, b, i, replacement in placed:
        if a < at:
            continue
        text = spelled(replacement.encode(), found[i])
        if text == body[a:b]:
            continue
        out += [body[at:a], text]
        at, n = b, n + 1
    return b"".join(out) + body[at:], n


def is_json(body: bytes) -> bool:
    """Whether a body is one JSON document, broken characters aside."""
    try:
        for _ in _scan(body.decode(errors="replace").encode()):
            pass
    except WalkError:
        return False
    return True


LEAVES = T.ArrayType(T.StructType([f for f in LEAF.fields if f.name not in ("identity", "identifiable", "error")]))


def walked(bodies: DataFrame, body: str = "body") -> DataFrame:
    """``bodies`` with ``leaves``, an array in document order, ``walk_error`` and ``is_json``, whether the body is JSON but for broken characters; one row stays one row."""
    kept = [c for c in bodies.columns if c not in ("leaves", "walk_error", "is_json")]
    schema = T.StructType([*(bodies.schema[c] if c != body else T.StructField(body, T.BinaryType()) for c in kept), T.StructField("leaves", LEAVES), T.StructField("walk_error", T.StringType()), T.StructField("is_json", T.BooleanType())])
    plain = bodies.select(*[(F.col(f"`{c}`").cast("binary") if c == body else F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(kept)])
    at = kept.index(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, names = to_arrow_type(LEAVES), LEAVES.elementType.names
        for part in parts(batches):
            found, errors = [], []
            bodies_of = part.column(at).to_pylist()
            for raw in bodies_of:
                try:
                    found.append([dict(zip(names, (i, x.path, x.value.decode(), x.encoded, x.key is not None, x.key), strict=True)) for i, x in enumerate(walk(raw or b""))])
                    errors.append(None)
                except (WalkError, RecursionError) as e:
                    found.append([])
                    errors.append(str(e) if isinstance(e, WalkError) else "max_depth")
            valid = [e is None or (e == "invalid_utf8" and is_json(raw)) for e, raw in zip(errors, bodies_of, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind), pa.array(errors, pa.string()), pa.array(valid, pa.bool_())], names=schema.names)

    return plain.mapInArrow(run, schema)


def spelled(replacement: bytes, leaf: Leaf) -> bytes:
    """A text as it must stand in a leaf's raw place."""
    for _ in leaf.chain:
        replacement = escape(replacement)
    return replacement


def restored_body(body: bytes, secrets: dict[str, str], token: re.Pattern) -> tuple[bytes, int]:
    """``body`` with the known placeholders restored, spelled at each leaf's depth, and their number.

    Placeholders outside string values (in member names) get one level of escapes; a body
    that is no JSON document gets the bare secrets. Unknown ones stay.
    """
    def secret_of(m: re.Match) -> bytes | None:
        found = secrets.get(m.group().decode())
        return None if found is None else found.encode()

    total = sum(secret_of(m) is not None for m in token.finditer(body))
    if not total:
        return body, 0
    try:
        found = walk(body)
    except (WalkError, RecursionError):
        return token.sub(lambda m: m.group() if (s := secret_of(m)) is None else s, body), total
    edits = []
    for leaf in found:
        for m in token.finditer(leaf.value):
            if (s := secret_of(m)) is not None:
                edits.append((*raw_span(leaf.chain, m.start(), m.end()), spelled(s, leaf)))
    out, at = [], 0
    for a, b, text in sorted(edits):
        if a >= at:
            out += [token.sub(lambda m: m.group() if (s := secret_of(m)) is None else escape(s), body[at:a]), text]
            at = b
    rest = token.sub(lambda m: m.group() if (s := secret_of(m)) is None else escape(s), body[at:])
    return b"".join(out) + rest, total


def restored_with(bodies: DataFrame, secrets: str, key: str, token: str, body: str = "body") -> DataFrame:
    """key, restored and n_restored of bodies that have a map of their own secrets; placeholders are spelled at the depth where they stand."""
    rows = bodies.select(key, F.col(f"`{body}`").cast("binary").alias("_body"), F.col(f"`{secrets}`").alias("_secrets"))
    schema = T.StructType([rows.schema[0], T.StructField("restored", T.BinaryType()), T.StructField("n_restored", T.IntegerType())])
    pattern = re.compile(token.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = [restored_body(raw, dict(own or []), pattern) for raw, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def rewritten(bodies: DataFrame, key: str, body: str = "body", edits: str = "edits") -> DataFrame:
    """key, redacted body and number of edits; ``edits`` is an array of (leaf_index, start, end, replacement), in bytes of the leaf.

    A body that cannot be walked, or has no edits, stays as it is.
    """
    joined = bodies.select(key, F.col(body).cast("binary").alias("body"), F.col(edits).alias("edits"))
    schema = T.StructType([joined.schema[key], T.StructField("redacted", T.BinaryType()), T.StructField("applied", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = []
            for raw, own in zip(batch.column("body").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                try:
                    out.append(rewrite(raw, [(e["leaf_index"], e["start"], e["end"], e["replacement"]) for e in own]) if own else (raw, 0))
                except (WalkError, RecursionError):
                    out.append((raw, 0))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32())], names=schema.names)

    return joined.mapInArrow(run, schema)
