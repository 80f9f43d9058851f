"""Whole-batch text kernels: words, shingles and their 64-bit hashes in NumPy.

Everything works on the UTF-8 bytes of an Arrow column, a slice of about half a
megabyte at a time, so that the scratch arrays stay small whatever the batch size.
Hashes are polynomial over a random byte table, finished with a 64-bit mixer: two
different words or shingles share one with probability about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_libc = ctypes.CDLL(None)
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _BYTE_VALUES[97:123]
_POSITION = _RANDOM.integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together hold at most ``limit`` bytes, or one longer row."""
    _, offsets = utf8(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Hand memory that a finished task has freed back to the system: its worker stays, beside stages that need the memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def map_rows(
    df: DataFrame, keep: Sequence[str], sources: Sequence[str], new: dict[str, T.DataType],
    make: Callable[[pa.RecordBatch], Sequence], limit: int = SLICE_BYTES, rows: int = 1 << 16,
) -> DataFrame:
    """The ``keep`` columns of ``df`` with columns made from ``sources``, a bounded run of rows at a time.

    ``make`` gets a batch whose columns are named ``s0``, ``s1``... for the sources and
    returns one value list or array for each new column. Runs are bounded by the bytes
    of the first source (a longer row makes a run of its own) and by ``rows``.
    """
    fields = [*(df.schema[k] for k in keep), *(T.StructField(k, v) for k, v in new.items())]
    schema = T.StructType(fields)
    kinds = [to_arrow_type(v) for v in new.values()]
    wide = df.select(*[df[f"`{k}`"].alias(f"k{i}") for i, k in enumerate(keep)], *[df[f"`{s}`"].alias(f"s{i}") for i, s in enumerate(sources)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run_of in slices(batch, "s0", limit):
                for at in range(0, run_of.num_rows, rows):
                    part = run_of.slice(at, rows)
                    made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(make(part), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(f"k{i}") for i in range(len(keep))), *made], names=schema.names)
        give_back()

    return wide.mapInArrow(run, schema)


def words(buf: np.ndarray, offsets: np.ndarray, fold: bool = True, borders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs without ASCII white space, A-Z folded if asked; ``borders`` are bytes before which a word ends too.

    Returns the words' hashes, first bytes, end bytes, and for each row the index of
    its first word (one more entry at the end).
    """
    n = len(buf)
    if not n:
        nothing = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), nothing, nothing, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if borders is not None:
        cut[borders] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED_VALUES if fold else _BYTE_VALUES)[buf] * up[:n], out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first])
    return hashes, first, last, np.searchsorted(first, offsets)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words; a row of fewer words has its whole sequence as one.

    Returns the shingles and for each row the index of its first one. Rows without
    words have none.
    """
    counts = np.diff(rows)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    total = int(at[-1])
    if not total:
        return np.zeros(0, np.uint64), at
    start = np.repeat(rows[:-1] - at[:-1], made) + np.arange(total)
    length = np.repeat(np.minimum(counts, k), made)
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    top = max(len(hashes) - 1, 0)
    for j in range(k):
        part = hashes[np.minimum(start + j, top)] * _POSITION[j]
        out += part if j == 0 else np.where(j < length, part, np.uint64(0))
    return mix(out), at


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal ``keys``, across batches; input sorted by them."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = tuple(c[a] for c in columns)
            if held and own != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
