"""Byte spans of pattern matches as Column expressions, without Python on the executors."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
MARK = "\x01"
EMPTY = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row; lambdas in ``use`` would compute it anew for each element."""
    return F.transform(F.array(value), use)[0]


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column ``name`` that is computed once a row whatever is asked of it later.

    Filters on a projection's column are moved below it with the column's whole expression
    in place of each mention, so that a search of texts would run once a mention; they do
    not pass a row that is exploded from an array of one.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array(value)).alias(name))


def _placed(pairs: Column) -> Column:
    """Spans of (v, g) pairs, match and gap before it: running sums within blocks, then of blocks, so that arrays grow little."""
    step = lambda acc, x: F.struct(
        (acc["at"] + x["g"] + F.octet_length(x["v"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + F.octet_length(x["v"])).alias("end"), x["v"].alias("value")))).alias("out"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("out"))
    cuts = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
    folded = F.transform(cuts, lambda k: F.aggregate(F.slice(pairs, k * BLOCK + 1, BLOCK), empty, step))
    follow = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def joined(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), follow, lambda acc: acc["out"])
        moved = lambda b, s: F.transform(b["out"], lambda x: F.struct((x["start"] + s).alias("start"), (x["end"] + s).alias("end"), x["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, starts, moved))

    return let(folded, joined)


def matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in bytes.

    ``pattern`` must not match the empty string; it is not tried where the literal
    ``needs`` does not occur. A null text has no matches.
    """
    none = F.array().cast(EMPTY)
    # one search: matches are marked in the text, which is cut at the marks
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    between = lambda p: F.transform(F.sequence(F.lit(0), ((F.size(p) - 3) / 2).cast("int")), lambda i: F.struct(F.get(p, 2 * i + 1).alias("v"), F.octet_length(F.get(p, 2 * i)).alias("g")))
    once = let(marked, lambda p: F.when(F.size(p) > 1, let(between(p), _placed)).otherwise(none))
    # two searches where a text has the mark itself
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = lambda v: F.zip_with(v, F.slice(gaps, 1, F.size(v)), lambda v, g: F.struct(v.alias("v"), F.octet_length(g).alias("g")))
    twice = let(found, lambda v: F.when(F.size(v) > 0, let(pairs(v), _placed)).otherwise(none))
    made = F.when(F.contains(text, F.lit(MARK)), twice).otherwise(once)
    return F.when(F.contains(text, F.lit(needs)), made).otherwise(none) if needs else made


def literal_matches(text: Column, literal: str, fold: bool = False) -> Column:
    """Non-overlapping occurrences of a literal; ``fold`` ignores the case of A-Z."""
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)
    if fold:
        quoted = "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in quoted)
    return matches(text, quoted, None if fold else literal)


def trimmed_to(span: Column, value: Column) -> Column:
    """``span`` shortened to ``value``, a prefix of its own value."""
    return F.struct(span["start"].alias("start"), (span["start"] + F.octet_length(value)).alias("end"), value.alias("value"))

