"""Placeholders that chunk borders split, put together by a stateful operator on streams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.tokens import restore

_LIVE = re.compile(r"(?:_|__|__P|__PI|__PII|__PII_[a-z0-9_]{0,16}|__PII_[a-z0-9_]{1,16}?_[0-9a-f]{0,64}_?)\Z")
LONGEST = 6 + 16 + 1 + 64 + 2


def held_from(text: str) -> int:
    """Where the longest tail begins that may grow into a placeholder."""
    start = max(0, len(text) - LONGEST)
    m = _LIVE.search(text, start)
    return m.start() if m else len(text)


def whole_tokens(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", chunk: str = "chunk", last: str = "last") -> DataFrame:
    """stream, seq and text, cut anew so that no placeholder is split; works on streams and tables.

    Chunks are taken in order of ``seq`` from 0; those that come early wait in state.
    ``last`` marks a stream's end, which releases everything.
    """
    kind = chunks.schema[stream].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, following, waiting = state.get if state.exists else ("", 0, [])
        pending = {int(s): (c, bool(e)) for s, c, e in waiting}
        for frame in frames:
            pending |= {int(s): (c or "", bool(e)) for s, c, e in zip(frame[seq], frame[chunk], frame[last], strict=True)}
        out, ended = [], False
        while following in pending:
            text, ended = pending.pop(following)
            text = held + text
            cut = len(text) if ended else held_from(text)
            out.append((key[0], following, text[:cut]))
            held, following = text[cut:], following + 1
        if ended and not pending:
            state.remove()
        else:
            state.update((held, following, [(s, c, e) for s, (c, e) in sorted(pending.items())]))
        yield pd.DataFrame(out, columns=[stream, seq, "text"])

    return chunks.select(stream, seq, chunk, last).groupBy(stream).applyInPandasWithState(
        step, f"{stream} {kind}, {seq} long, text string", "held string, following long, waiting array<struct<s:long,c:string,e:boolean>>", "append", GroupStateTimeout.NoTimeout)


def restored_stream(chunks: DataFrame, vault: DataFrame, path: str, checkpoint: str, stream: str = "stream_id", seq: str = "seq") -> StreamingQuery:
    """Run a stream of chunks to Parquet at ``path`` with its placeholders restored; a batch that runs again replaces what it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        keyed = batch.selectExpr("*", f"struct({stream}, {seq}) AS _key")
        restore(keyed, vault, "_key", "text").selectExpr("_key.*", "restored", "n_restored").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return whole_tokens(chunks, stream, seq).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
