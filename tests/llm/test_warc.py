"""WARC archives and their capture index against full scans."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palisade.llm import warc
from palisade.llm.staging import fresh_path


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def want(rows):
    plain = [(i, u, (h or "").encode()) for i, u, h in rows]
    top = {}
    for i, _, h in plain:
        if len(h) >= 1000:
            top[h] = max(top.get(h, -1), -1 if i is None else i)
    out = []
    for i, _, h in plain:
        again = len(h) >= 1000 and top[h] != -1 and i != top[h]
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", top[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    big = "é\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://b.a.org/x?q=1", big), (2, None, big), (3, "http://c.a.org", None), (4, "u", "small"), (5, "u", "small"), (None, "u", big), (7, "two\r\nlines", "x" * 999),
            (8, "u", "y" * 1000), (8, "v", "y" * 1000), (6, "w", "y" * 1000), (9, "http://long/", "long text " * 300_000), (10, "", "")]
    pages = pages_of(spark, rows).withColumn("size", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("maybe", F.lit(None).cast("boolean"))
    assert sorted(map(tuple, warc.round_trip(pages).collect()), key=str) == want(rows)
    assert warc.round_trip(pages_of(spark, [])).count() == 0
    nameless = [(None, "u", "z" * 1000), (None, "u", "z" * 1000)]
    assert sorted(map(tuple, warc.round_trip(pages_of(spark, nameless)).collect()), key=str) == want(nameless)


@pytest.mark.parametrize(("url", "key"), [
    ("http://b.a.org/x", "org,a,b)/x"), ("http://b.A.org:8080/X#y", "org,a,b):8080/X"), ("ftp://me:pw@b.a.org/?q", "org,a,b)/?q"), ("http://10.0.0.1:80/a", "10.0.0.1):80/a"),
    ("http://[::1]/a", "[::1])/a"), ("b.a", "a,b)/"), ("", ")/"), ("http://a.org?x=http://b/", "org,a)/?x=http://b/"), ("http://a.org:/x", "org,a)/x"), ("http://h/a@b:1", "h)/a@b:1")])
def test_url_key(spark, url, key):
    assert spark.range(1).select(warc.url_key(F.lit(url))).first()[0] == key


def test_index_against_scan(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h{rng.randrange(30)}.example.org{':81' * rng.randrange(2)}/{rng.choice('aäBb')}{rng.randrange(4)}", "p" * rng.randrange(40)) for i in range(900)]
    rows += [(1000 + i, "http://hot.example.org/", "q" * (i % 7)) for i in range(300)]
    pages = pages_of(spark, rows).repartition(3)
    path, at = fresh_path(spark, "archives"), fresh_path(spark, "index")
    warc.write(pages, path, file_bytes=40_000)
    found = warc.captures(spark, path)
    warc.build_index(found, at, block_lines=7, ranges=5)
    index = warc.CaptureIndex(spark, at)
    assert len(index.top) > 1 and index.directory.count() > 100
    asked = ["http://hot.example.org/", "http://you@hot.example.org/#z", "http://none.example.org/", "http://h3.example.org/ä1", "http://H3.example.org:81/B2", "http://hot.example.org/x", ""]
    key_of = {u: k for u, k in found.select("url", warc.url_key(F.col("url"))).distinct().collect()}
    keys = {r[0] for r in spark.createDataFrame([(u,) for u in asked], "url string").select(warc.url_key(F.col("url"))).collect()}
    scan = sorted((key_of[r["url"]], r["page_id"], r["file"], r["offset"], r["length"]) for r in found.collect() if key_of[r["url"]] in keys)
    got = index.captures(spark.createDataFrame([(u,) for u in asked], "url string"))
    assert sorted((r["k"], r["page_id"], r["file"], r["offset"], r["length"]) for r in got.collect()) == scan and len(scan) > 300
    texts = {i: h for i, _, h in rows}
    read = warc.fetch(got).collect()
    assert len(read) == len(scan) and all(bytes(r["payload"]).decode() == texts[r["page_id"]] for r in read)
    assert index.captures(pages).count() == len(rows)
