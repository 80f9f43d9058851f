"""Bit maps of fixed size that tell which rows may have a key, so that all others need no shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

BITS, ROW_WORDS = 1 << 26, 512


def _slot(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def bit_map(rows: DataFrame, *keys: str) -> DataFrame:
    """k, words: the hashes of ``keys`` that occur, ``ROW_WORDS`` 64-bit words to a row; 8 MB at most, whatever the input."""
    slot = _slot([F.col(k) for k in keys])
    words = rows.select(F.shiftright(slot, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    lines = words.groupBy(F.floor(F.col("w") / ROW_WORDS).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("w") % ROW_WORDS, "b"))).alias("m"))
    return stage(lines.select("k", F.transform(F.sequence(F.lit(0), F.lit(ROW_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0))).alias("words")), "bits")


def flagged(df: DataFrame, bits: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with the boolean ``name``: false where the row's keys are surely not in the bit map, true if they are (and for a few others)."""
    slot = _slot(keys)
    kept = [F.col(f"d.`{c}`") for c in df.columns]
    row = F.floor(F.shiftright(slot, 6) / ROW_WORDS)
    word = F.get("b.words", (F.shiftright(slot, 6) % ROW_WORDS).cast("int"))
    joined = df.alias("d").join(F.broadcast(bits).alias("b"), row == F.col("b.k"), "left")
    return joined.select(*kept, F.coalesce(F.getbit(word, F.pmod(slot, F.lit(64)).cast("int")) == 1, F.lit(False)).alias(name))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column has it (names are compared without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def key_bits(rows: DataFrame, key: str, bits: int = 26) -> np.ndarray:
    """The top ``bits`` bits of evenly hashed 64-bit keys that occur, as 64-bit words: 8 MB for 26 bits, whatever the input."""
    slot = F.shiftrightunsigned(key, 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    found = rows.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    words = np.zeros(1 << bits - 6, np.uint64)
    words[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return words


def has_bits(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (64-bit hashes) may be among those of ``key_bits``."""
    slot = keys.astype(np.uint64) >> np.uint64(64 - (len(words).bit_length() - 1 + 6))
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
