"""Placeholders restored in server-sent events, also where one is split over several events.

The text of a JSON envelope comes in fragments: a placeholder that begins at the end of a
string value is continued by the value with the same identity (path, scalars beside it and
occurrence) in the next envelope. The fragments go from the events that hold them, and the
secret is spelled into the value that completes it, at its depth. Framing, comments and
all other bytes stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tokens import TOKEN
from ..sources import bodies as b
from .restore import LONGEST, held_from

# Fixed value: bytes that may wait for the end of a placeholder.
MOST_HELD = 256 << 10
_TOKEN, _LINE = re.compile(TOKEN), re.compile(rb"[^\r\n]*(?:\r\n|\n|\r|$)")


def records(raw: bytes) -> Iterator[tuple[bytes, tuple[int, int] | None, bool]]:
    """Each event's bytes, its blank line included, the place of its data if it has one line of it, and whether a blank line ends it.

    An event of more than ``MOST_HELD`` bytes is not looked into.
    """
    at, start, data = 0, 0, []
    while at < len(raw):
        m = _LINE.match(raw, at)
        line = m.group().rstrip(b"\r\n")
        if line.startswith(b"data:") or line == b"data":
            skip = 6 if line.startswith(b"data: ") else min(5, len(line))
            data.append((at + skip - start, at + len(line) - start))
        at = m.end()
        if not line or at >= len(raw):
            yield raw[start:at], data[0] if len(data) == 1 and at - start <= MOST_HELD else None, not line
            start, data = at, []


@dataclass
class _Event:
    raw: bytes
    span: tuple[int, int] | None
    leaves: list[b.Leaf] = field(default_factory=list)
    names: list[str | None] = field(default_factory=list)
    edits: list[tuple[int, int, int, str]] = field(default_factory=list)  # leaf, start, end (bytes of its value), text

    def read(self) -> None:
        """Find the leaves of the data; none where it is no JSON."""
        try:
            self.leaves = b.walk(self.value)
            self.names = b.identities(self.leaves)
        except (b.WalkError, RecursionError):
            self.leaves, self.names = [], []

    @property
    def value(self) -> bytes:
        return self.raw[self.span[0] : self.span[1]] if self.span else b""


def _tail(text: str, start: int) -> str:
    """What at the end of ``text`` may grow into a placeholder, after the whole ones and ``start``."""
    for m in _TOKEN.finditer(text):
        start = max(start, m.end())
    return text[start:][held_from(text[start:]) :]


class Stitcher:
    """Goes through the events of one stream; ``secret_of`` gives the secret of a placeholder or None."""

    def __init__(self, secret_of: Callable[[str], str | None]):
        self.secret_of, self.restored = secret_of, 0
        self.waiting: list[_Event] = []
        self.queued = 0  # bytes of the events that wait, those that nothing held refers to included
        self.carry, self.name, self.held = "", None, 0
        self.parts: list[tuple[_Event, int, int, int]] = []

    def _drop(self) -> None:
        self.carry, self.name, self.parts, self.held = "", None, [], 0

    def _hold(self, event: _Event, leaf: int, text: str) -> None:
        """Wait for the end of ``text``, which stands at the end of a leaf, if there is room."""
        if len(event.raw) * 2 + len(text) + self.held <= MOST_HELD:
            size = len(event.leaves[leaf].value)
            self.carry, self.name, self.held = self.carry + text, event.names[leaf], self.held + 2 * len(event.raw)
            self.parts.append((event, leaf, size - len(text.encode()), size))
        else:
            self._drop()

    def _last_tail(self, event: _Event, first: int = 0, start: int = 0) -> None:
        """Hold what the last of the leaves from ``first`` on that can be told apart leaves open."""
        for k in range(len(event.leaves) - 1, first - 1, -1):
            if event.names[k] is not None and (text := _tail(event.leaves[k].value.decode(), start if k == first else 0)):
                self._hold(event, k, text)
                return

    def _whole(self, event: _Event, leaf: int, start: int) -> None:
        """Edits for the whole placeholders of a leaf from byte ``start`` on."""
        value = event.leaves[leaf].value
        for m in re.finditer(TOKEN.encode(), value[start:]):
            if (secret := self.secret_of(m.group().decode())) is not None:
                event.edits.append((leaf, start + m.start(), start + m.end(), secret))
                self.restored += 1

    def add(self, event: _Event) -> None:
        self.waiting.append(event)
        self.queued += len(event.raw)
        if self.parts and self.queued > MOST_HELD:
            self._drop()
        if not event.span:
            return
        event.read()
        if not any(n is not None for n in event.names):
            self._drop()
            return
        same = [k for k, n in enumerate(event.names) if n == self.name] if self.carry else []
        if len(same) == 1 and self._continued(event, same[0]):
            return
        if not same or len(same) > 1:
            self._drop()
        for k in range(len(event.leaves)):
            self._whole(event, k, 0)
        if not self.carry:
            self._last_tail(event)

    def _continued(self, event: _Event, leaf: int) -> bool:
        """Whether the leaf ends or goes on with what is held."""
        value = event.leaves[leaf].value.decode()
        both = self.carry + value
        m = _TOKEN.match(both)
        if m and m.end() > len(self.carry):
            secret, origin = self.secret_of(m.group()), self.parts[0][0].leaves[self.parts[0][1]]
            torn = not origin.encoded and origin.value.lstrip(b" \t\r\n")[:1] in (b"{", b"[") and not b.is_json(origin.value)
            if secret is None or (torn and b.escape(secret.encode()) != secret.encode()):
                self._drop()
                return False
            cut = len(value[: m.end() - len(self.carry)].encode())
            for old, k, start, end in self.parts:
                old.edits.append((k, start, end, ""))
            event.edits.append((leaf, 0, cut, secret))
            self.restored += 1
            self._drop()
            for k in range(len(event.leaves)):
                self._whole(event, k, cut if k == leaf else 0)
            self._last_tail(event, leaf, m.end() - len(both) + len(value))
            return True
        if held_from(both) == 0 and len(both) <= LONGEST:
            for k in range(len(event.leaves)):
                self._whole(event, k, 0)
            self._hold(event, leaf, value)
            return True
        self._drop()
        return False

    def ready(self, end: bool = False) -> Iterator[bytes]:
        """The bytes of the events that nothing held refers to."""
        keep = len(self.waiting) if end or not self.parts else next(i for i, e in enumerate(self.waiting) if e is self.parts[0][0])
        for event in self.waiting[:keep]:
            if event.edits:
                value, _ = b.rewrite(event.value, event.edits)
                yield event.raw[: event.span[0]] + value + event.raw[event.span[1] :]
            elif event.span and not event.leaves and _TOKEN.search(event.value.decode(errors="replace")):
                value, n = b.restored_body(event.value, self._told(event.value), re.compile(TOKEN.encode()))
                self.restored += n
                yield event.raw[: event.span[0]] + value + event.raw[event.span[1] :]
            else:
                yield event.raw
        self.queued -= sum(len(e.raw) for e in self.waiting[:keep])
        self.waiting = self.waiting[keep:]

    def saved(self) -> tuple[tuple, list[tuple]]:
        """What is needed to go on elsewhere: (carry, name, held, parts, restored) and (raw, start, end, edits) of each event that waits."""
        at = {id(e): i for i, e in enumerate(self.waiting)}
        parts = [(at[id(e)], leaf, start, end) for e, leaf, start, end in self.parts]
        return (self.carry, self.name, self.held, parts, self.restored), [(e.raw, *(e.span or (-1, -1)), list(e.edits)) for e in self.waiting]

    def resume(self, state: tuple, events: list[tuple]) -> None:
        """Go on from what :meth:`saved` gave."""
        self.carry, self.name, self.held, parts, self.restored = state
        self.waiting = [_Event(bytes(raw), (start, end) if start >= 0 else None, edits=[tuple(x) for x in edits]) for raw, start, end, edits in events]
        self.queued = sum(len(e.raw) for e in self.waiting)
        for e in self.waiting:
            if e.span:
                e.read()
        self.parts = [(self.waiting[i], leaf, start, end) for i, leaf, start, end in parts]

    def _told(self, value: bytes) -> dict[str, str]:
        names = {m.group().decode() for m in re.finditer(TOKEN.encode(), value)}
        return {n: s for n in names if (s := self.secret_of(n)) is not None}


def stitched(raw: bytes, secret_of: Callable[[str], str | None]) -> tuple[bytes, int]:
    """A stream's bytes with its placeholders restored, and their number."""
    run, out = Stitcher(secret_of), []
    for record, span, _ in records(raw):
        run.add(_Event(record, span))
        out += run.ready()
    out += run.ready(end=True)
    return b"".join(out), run.restored


def restored_streams(streams: DataFrame, minted: DataFrame, key: str = "stream_id", body: str = "body") -> DataFrame:
    """key, restored and n_restored of whole event streams.

    What placeholders a stream has is known only when split ones are put together, so
    streams are gone through twice: for their placeholders, which meet the vault
    (placeholder, secret) in a join, and with their own secrets.
    """
    plain = streams.select(F.col(key).alias(key), F.col(body).cast("binary").alias("body"))
    # streams of the same bytes need the same secrets; keys may be shared or null
    marked = plain.withColumn("_text", F.sha2("body", 256))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for k, raw in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen: set[str] = set()
                stitched(raw or b"", lambda name, seen=seen: seen.add(name) or "")
                keys += [k] * len(seen)
                found += sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], pa.string()), pa.array(found, pa.string())], names=["_text", "placeholder"])

    asked = marked.select("_text", "body").mapInArrow(names, "_text string, placeholder string").distinct()
    own = asked.join(minted.select("placeholder", "secret"), "placeholder").groupBy("_text").agg(F.map_from_entries(F.collect_set(F.struct("placeholder", "secret"))).alias("secrets"))
    schema = T.StructType([plain.schema[key], T.StructField("restored", T.BinaryType()), T.StructField("n_restored", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [stitched(raw or b"", dict(s or []).get) for raw, s in zip(batch.column("body").to_pylist(), batch.column("secrets").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int32())], names=schema.names)

    return marked.join(own, "_text", "left").select(key, "body", "secrets").mapInArrow(run, schema)
