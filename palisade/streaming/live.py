"""Live event streams: decoded, evaluated and restored over micro-batches with bounded state.

Two stateful operators with stateless work between them. The first puts the chunks of a
stream in order and cuts them into events, whatever the chunks' borders; a stream without
chunks for a while is ended by a timer. Events are rows then, and rules see them as they
see any table. The second restores placeholders, also those split over events, and holds
no more than the events that one unfinished placeholder refers to; an event that a rule
blocks ends the stream: what is held is dropped, one refusal is given out and all that
comes later is swallowed.

Both keep no more than ``MOST_HELD`` bytes of a stream beside its own secrets: an event
beyond that passes as it is, and a stream whose missing chunk stays away while more than
that comes early is refused. Chunks that come again are ignored. A stream ends with its
last chunk; its number may then not be used again while the query runs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import requests
from ..operators.detectors import Rule
from ..sources import bodies as b
from .events import MOST_HELD, Stitcher, _Event, records

IDLE_MS = 60_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "stream string, nth long, raw binary, start int, end int, failed string, last boolean"
OUT = "stream string, nth long, data binary, n_restored long, refused string"


class _Ordered(StatefulProcessor):
    """Rows of a stream by number from 0: early ones wait, repeated ones are dropped."""

    def _early(self, handle: StatefulProcessorHandle, kind: str) -> None:
        self.early = handle.getMapState("early", "number long", kind)

    def _in_order(self, rows: Iterator[tuple[int, tuple]], following: int) -> Iterator[tuple]:
        """Each row that is due, one after the other."""
        fresh: dict[int, tuple] = {}
        for number, row in rows:
            if number >= following and number not in fresh:
                fresh[number] = row
        while True:
            if following in fresh:
                yield fresh.pop(following)
            elif self.early.containsKey((following,)):
                row = tuple(self.early.getValue((following,)))
                self.early.removeKey((following,))
                yield row
            else:
                break
            following += 1
        for number, row in fresh.items():
            if number > following and not self.early.containsKey((number,)):
                self.early.updateValue((number,), row)

    def _waiting(self) -> int:
        return sum(len(row[0] or b"") for row in self.early.values())


class Events(_Ordered):
    """Chunks to events: what is before the first blank line that has not come waits."""

    def __init__(self, idle_ms: int | None = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "following long, nth long, tail binary, passing boolean, empty boolean, closed boolean")
        self._early(handle, "chunk binary, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        following, nth, tail, passing, empty, closed = self.place.get() if self.place.exists() else (0, 0, b"", False, True, False)
        if closed:
            return
        out: list[tuple] = []
        parts, tail = [bytes(tail)], b""
        for chunk, last in self._in_order(((r["seq"], (bytes(r["chunk"] or b""), bool(r["last"]))) for r in rows), following):
            following += 1
            parts.append(chunk)
            if last:
                closed = True
                break
        tail = b"".join(parts)
        if passing:
            tail, passing, empty = self._passed(tail, empty, out)
        if not passing:
            tail = self._cut(tail, closed, out)
            if len(tail) > MOST_HELD:
                empty = tail[-1:] in (b"\n", b"\r")
                out.append((tail, -1, -1))
                tail, passing = b"", True
        failed = None
        if not closed and self._waiting() > MOST_HELD:
            failed, closed, tail = "stream_gap", True, b""
        yield from self._rows(key, nth, out, closed, failed)
        nth += len(out)
        if closed:
            self._ended(following, nth)
        else:
            self.place.update((following, nth, tail, passing, empty, False))
            self._no_timers()
            if self.idle_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.place.exists():
            return
        following, nth, tail, _, _, closed = self.place.get()
        if closed:
            return
        out: list[tuple] = []
        self._cut(bytes(tail), True, out)
        yield from self._rows(key, nth, out, True, None)
        self._ended(following, nth + len(out))

    def _no_timers(self) -> None:
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)

    def _ended(self, following: int, nth: int) -> None:
        self._no_timers()
        self.early.clear()
        self.place.update((following, nth, b"", False, True, True))

    @staticmethod
    def _cut(tail: bytes, end: bool, out: list[tuple]) -> bytes:
        """Events of ``tail`` to ``out``; what is not ended yet is given back."""
        for raw, span, whole in records(tail):
            if not (whole or end):
                return raw
            out.append((raw, *(span or (-1, -1))))
        return b""

    @staticmethod
    def _passed(tail: bytes, empty: bool, out: list[tuple]) -> tuple[bytes, bool, bool]:
        """The rest of an event that passes as it is: (what follows it, whether it goes on, whether its last line is empty so far)."""
        lead = b"" if empty else b"x"
        for raw, _, whole in records(lead + tail):
            part = raw[len(lead) :]
            out.append((part, -1, -1))
            return tail[len(part) :], not whole, raw[-1:] in (b"\n", b"\r")
        return b"", True, empty

    @staticmethod
    def _rows(key: tuple, nth: int, out: list[tuple], closed: bool, failed: str | None) -> Iterator[Row]:
        if closed and (not out or failed):
            out.append((b"", -1, -1))
        for i, (raw, start, end) in enumerate(out):
            last = closed and i == len(out) - 1
            yield Row(stream=key[0], nth=nth + i, raw=raw, start=start, end=end, failed=failed if last else None, last=last)

    def close(self) -> None:
        pass


class Restored(_Ordered):
    """Events to the bytes that are final, with the stream's own secrets; a failed event ends the stream with a refusal."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "following long, given long, carry string, name string, held int, parts array<struct<event:int,leaf:int,start:int,end:int>>, restored int, closed boolean")
        self.segments = handle.getListState("segments", "raw binary, start int, end int, edits array<struct<leaf:int,start:int,end:int,text:string>>")
        self.secrets = handle.getMapState("secrets", "placeholder string", "secret string")
        self._early(handle, "raw binary, start int, end int, failed string, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        following, given, *state, closed = self.place.get() if self.place.exists() else (0, 0, "", None, 0, [], 0, False)
        if closed:
            return
        run = Stitcher(self._secret)
        run.resume((state[0], state[1], state[2], [tuple(p) for p in state[3]], state[4]), [tuple(s) for s in self.segments.get()])
        out, refused = [], None
        for raw, start, end, failed, last in self._in_order(self._told(rows), following):
            following += 1
            if failed is not None:
                # nothing of this batch that was still held, nothing later
                refused, closed, run.waiting = failed, True, []
                break
            run.add(_Event(bytes(raw), (start, end) if start >= 0 else None))
            out += run.ready(end=last)
            if last:
                closed = True
                break
        data = b"".join(out)
        if data or (closed and refused is None):
            yield Row(stream=key[0], nth=given, data=data, n_restored=run.restored, refused=None)
            given, run.restored = given + 1, 0
        if refused is not None:
            yield Row(stream=key[0], nth=given, data=refusal(refused), n_restored=0, refused=refused)
            given += 1
        if closed:
            self.segments.clear()
            self.secrets.clear()
            self.early.clear()
            self.place.update((following, given, "", None, 0, [], 0, True))
            return
        (carry, name, held, parts, restored), events = run.saved()
        self.place.update((following, given, carry, name, held, parts, restored, False))
        self.segments.put(events) if events else self.segments.clear()

    def _told(self, rows: Iterator[Row]) -> Iterator[tuple[int, tuple]]:
        got = []
        for r in rows:
            for placeholder, secret in dict(r["secrets"] or ()).items():
                self.secrets.updateValue((placeholder,), (secret,))
            got.append((r["nth"], (bytes(r["raw"]), r["start"], r["end"], r["failed"], r["last"])))
        return iter(got)

    def _secret(self, placeholder: str) -> str | None:
        return self.secrets.getValue((placeholder,))[0] if self.secrets.containsKey((placeholder,)) else None

    def close(self) -> None:
        pass


def refusal(rule: str) -> bytes:
    """The one event that a refused stream ends with: a code and the rule, never content."""
    document = {"error": rule} if rule == "stream_gap" else {"error": "rule_blocked", "rule_id": rule}
    return b"event: error\ndata: " + json.dumps(document, separators=(",", ":")).encode() + b"\n\n"


def events(chunks: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The ``EVENTS`` columns of a stream of chunks (stream, seq from 0, chunk, last).

    Without ``idle_ms`` no timer ends a stream: for queries that are to stop when all input
    is read, as one with timers keeps waiting for them.
    """
    rows = chunks.select(F.col("stream").cast("string").alias("stream"), F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("binary").alias("chunk"), F.col("last").cast("boolean").alias("last"))
    return rows.groupBy("stream").transformWithState(Events(idle_ms), EVENTS, "append", "none" if idle_ms is None else "processingTime")


def judged(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Events with ``failed``, the first rule that blocks, where their data is JSON with such a finding; rules that redact do not see responses."""
    data = F.when(F.col("start") >= 0, F.substring("raw", F.col("start") + 1, F.col("end") - F.col("start")))
    walked = b.walked(found.withColumn("data", data), "data")
    made = requests.evaluated(walked, rules, phase="response")
    by = F.when(F.col("action") == "block", F.coalesce(F.try_element_at("rule_ids", F.lit(1)), F.col("refusal"), F.lit("budget")))
    return made.select("stream", "nth", "raw", "start", "end", F.coalesce("failed", by).alias("failed"), "last")


def restored(found: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """The ``OUT`` columns: what of each stream is final, in order of ``nth``; ``secrets`` has stream, placeholder and secret."""
    if secrets is None:
        told = found.withColumn("secrets", F.lit(None).cast("map<string,string>"))
    else:
        own = secrets.groupBy(F.col("stream").cast("string").alias("_stream")).agg(F.map_from_entries(F.collect_set(F.struct("placeholder", "secret"))).alias("secrets"))
        # a stream's first event brings its secrets
        told = found.join(own, (F.col("stream") == F.col("_stream")) & (F.col("nth") == 0), "left").drop("_stream")
    return told.groupBy("stream").transformWithState(Restored(), OUT, "append", "none")


def restored_chunks(chunks: DataFrame, secrets: DataFrame | None = None, rules: Sequence[Rule] = (), idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Streams of chunks decoded, judged by response rules and restored; the session must use ``STORE`` for its state."""
    found = events(chunks, idle_ms)
    return restored(judged(found, rules) if rules else found, secrets)
