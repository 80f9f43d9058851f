"""Patterns are searched once a text, as RE2 means them, and cheaply where that changes nothing."""

import duckdb
import pytest
from pyspark.sql import functions as F

from palisade.functions.re2 import java, needed
from palisade.functions.spans import matches

TEXTS = ["", " aab", " aa", "aa aab!", "x\x01aa\x01 b", "\x01", "é aa.\nbb\n", "a_1@b-c.d a@", "((a)", "foo bar.  Ünd", "a\nb", "ſ less les"]
PATTERNS = [r"\s[a]*\b", r"\sa+\b", r"a*\Bb", r"\Ba\b.", r"\b[^\w]+\b", r"(\w+)@([\w-]+)", r"\w+\W*$", r"(?m)^[^b]+$", r"(?m)^.+\s*$", r"(a+)+b", r"a+(a|b)", r"[(].*?[)]", r"\x01a?", r"(?i)\bles?\b", r"\W+\b\w", r"[^\x00-\x{10FFFF}]|a"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_as_re2(spark, pattern):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(-1, None)], "i int, t string")
    got = {r[0]: [(m["start"], m["end"], m["value"]) for m in r[1]] for r in df.select("i", matches(F.col("t"), java(pattern), needed(pattern))).collect()}
    assert got.pop(-1) == []
    for i, t in enumerate(TEXTS):
        want = duckdb.execute("SELECT regexp_extract_all(?, ?)", [t, f"(?-s){pattern}"]).fetchone()[0]
        assert [v for *_, v in got[i]] == want
        assert all(t.encode()[a:z].decode() == v for a, z, v in got[i])
        assert all(x[1] <= y[0] for x, y in zip(got[i], got[i][1:], strict=False))


def test_cheap():
    assert java(r"\w+\W*$").count("+") == 3 and needed(r"(\w+)@x?") == "@"  # no repetition gives back
    assert java(r"a\b") == r"a(?![0-9A-Za-z_])" and java(r"\Ba") == r"(?<=[0-9A-Za-z_])a"
