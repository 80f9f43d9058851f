"""Source divergence against a plain count in Python and the SQL."""

import re
from collections import Counter
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from palisade.llm import divergence
from palisade.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, text string, lang string, source string"


def want(rows):
    docs = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for _, t, la, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t in df if df[t] >= 30)
        count = {s: Counter(t for _, x, ts in own if x == s for t in ts if df[t] >= 30) for s in {d[1] for d in own}}
        total = sum(count.values(), Counter())

        def p(c, t, v=len(kept)):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v)

        for s in count:
            pair = [(sum(abs(p(count[s], t) - p(count[o], t)) for t in kept), o) for o in count if o != s]
            term = [(p(count[s], t) - p(total, t), t) for t in kept if count[s][t] and p(count[s], t) > p(total, t)]
            for part, items, top in (("pair", pair, None), ("term", term, 50)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def rows_of():
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a, b in product(range(9), range(9))] + ["Überall", "naïve", "ПРИВЕТ", "中文字", "a𝒳b", "É", "é", "İx"]
    rows = []
    for i in range(900):
        picked = [words[(i * 7 + k * k * (1 + i % 4)) % len(words)] for k in range(i % 23)]
        text = "-".join(w.upper() if (i + k) % 5 == 0 and w.isascii() else w for k, w in enumerate(picked)) + " x1y_z\x00q\x7f[ab]`c`{d}@e"
        rows.append((i, text, ("en", "de", "en", None)[i % 4], ("s", "ä", "S", None, "z", "hot", "hot", "hot")[(i // 4) % 8]))
    rows += [(1, None, "fr", "one"), (1, None, "fr", "one"), (None, "", "fr", None), (5, "1 2 3", None, "digits"), (6, "rare word", "xx", "y"), (7, "rare " * 5000, "xx", "w")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return rows_of()


def test_equals_plain_counts_and_sql(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, divergence.audit(df).collect())) == want(rows)
    df.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op12_source_divergence"]).fetchall()) == want(rows)


def test_clashes_and_empty(spark, rows):
    few = rows[:200]
    df = spark.createDataFrame(few, SCHEMA).withColumns({c: F.lit("clash") for c in ("term", "t", "n", "docs", "counts", "m", "sources", "p", "part", "rank", "by_source")})
    assert sorted(map(tuple, divergence.audit(df).collect())) == want(few)
    empty = divergence.audit(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_scaled_beyond_longs(spark):
    big = 10**13
    row = spark.range(1).select(divergence.scaled(F.lit(big), F.lit(7 * big), F.lit(3)).alias("p")).head()
    assert row["p"] == 1 + 10**9 * (big + 5) // (7 * big + 15)
