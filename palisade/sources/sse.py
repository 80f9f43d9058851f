"""Server-sent events from chunks of streams.

Lines end with LF, CRLF or a lone CR; comments are skipped; several data lines are joined
by LF; a blank line dispatches an event only if it has data, else event and retry are
dropped; id persists; the end of a stream dispatches what is held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BREAK = re.compile(rb"\r\n|\n|\r")


class Decoder:
    """Feed bytes, get events; any split of the bytes gives the same events."""

    def __init__(self):
        self.held, self.after_cr = [], False  # parts of a line
        self.event, self.data, self.id, self.has_id, self.retry = "", [], "", False, ""

    def _line(self, line: bytes) -> tuple | None:
        if not line:
            data, event, retry = self.data, self.event, self.retry
            self.data, self.event, self.retry = [], "", ""
            return (event or "message", b"\n".join(data), self.id, self.has_id, retry) if data else None
        name, colon, value = line.partition(b":")
        value = value.removeprefix(b" ")
        if not name and colon:
            return None
        text = value.decode("utf-8", "replace")
        if name == b"data":
            self.data.append(value)
        elif name == b"event":
            self.event = text
        elif name == b"id":
            self.id, self.has_id = text, True
        elif name == b"retry":
            self.retry = text
        return None

    def feed(self, chunk: bytes) -> Iterator[tuple]:
        if self.after_cr and chunk:
            chunk, self.after_cr = chunk.removeprefix(b"\n"), False
        at = 0
        for m in _BREAK.finditer(chunk):
            self.held.append(chunk[at : m.start()])
            line, self.held = b"".join(self.held), []
            at = m.end()
            self.after_cr = m.group() == b"\r" and at == len(chunk)
            if made := self._line(line):
                yield made
        if at < len(chunk):
            self.held.append(chunk[at:])

    def close(self) -> Iterator[tuple]:
        if self.held:
            self._line(b"".join(self.held))
            self.held = []
        if made := self._line(b""):
            yield made


def events(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """stream, nth, event, data, id, has_id and retry of every event; streams are gone through in order, holding one line."""
    schema = T.StructType([chunks.schema[stream], T.StructField("nth", T.IntegerType()), T.StructField("event", T.StringType()), T.StructField("data", T.StringType()),
                           T.StructField("id", T.StringType()), T.StructField("has_id", T.BooleanType()), T.StructField("retry", T.StringType())])
    placed = chunks.select(F.col(stream).alias("s"), seq, F.col(chunk).cast("binary").alias("c")).repartition("s").sortWithinPartitions("s", seq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, mark, nth, kind = Decoder(), None, 0, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)

        def number(made: Iterator[tuple], out: list[tuple]) -> None:
            nonlocal nth
            for event, data, ident, has_id, retry in made:
                out.append((mark[0], nth, event, data.decode("utf-8", "replace"), ident, has_id, retry))
                nth += 1

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for s, c in zip(batch.column("s").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if mark != (s,):
                    if mark:
                        number(decoder.close(), out)
                    decoder, mark, nth = Decoder(), (s,), 0
                number(decoder.feed(c or b""), out)
            yield batch_of(out)
        if mark:
            out = []
            number(decoder.close(), out)
            yield batch_of(out)

    return placed.mapInArrow(run, schema)
