"""License scans against full local alignment, repeated notices, odd tables."""

import random
import time

import pyarrow as pa
import pytest

from palisade.llm import licenses


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, license string")


def test_licenses(spark):
    texts = ["x y z\nLicensed under the Apache License, Version 2.0.\n", "Released under the MIT license", None, "", "nothing"]
    got = {(r["doc_id"], r["license"], texts[r["doc_id"]][r["start"] : r["end"]]) for r in licenses.scan(frame(spark, texts)).collect()}
    assert got == {(0, "apache-2.0", "Licensed under the Apache License, Version 2.0"), (1, "mit", "Released under the MIT license")}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12])
@pytest.mark.parametrize("line", ["Released under the MIT License", "Licensed under CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0"])
def test_adjacent_licenses(n, line):
    index = licenses.Index(licenses.TEMPLATES)
    name = next(k for k, v in licenses.TEMPLATES.items() if v == line)
    hashes, _, _, rows = licenses.tokens(*licenses.utf8(pa.array(["some words before\n" + (line + "\n") * n + "and after"])))
    prints, place = licenses.winnow(hashes, rows)
    found = [(int(index.row[e]), int(index.place[e]), int(p)) for h, p in zip(prints, place, strict=True) for e in (index.prints == h).nonzero()[0]]
    width = len(index.words[index.names.index(name)])
    got = [(a, b) for t, _, a, b in licenses.matches(hashes, index, found, licenses.LEAST_COVERAGE) if index.names[t] == name]
    assert got == [(3 + width * i, 3 + width * (i + 1)) for i in range(n)]


def full(template, text):
    """Score of the best local alignment without a band."""
    above, best = [0] * (len(text) + 1), 0
    for w in template:
        row = [0]
        for j, x in enumerate(text, 1):
            row.append(max(0, above[j - 1] + (2 if w == x else -1), above[j] - 1, row[j - 1] - 1))
        best = max(best, max(row))
        above = row
    return best


def test_align_against_full_alignment():
    import numpy as np

    rng = random.Random(4)
    for _ in range(150):
        template = np.array([rng.randrange(9) for _ in range(rng.randrange(1, 30))], np.uint64)
        text = np.array([rng.randrange(9) for _ in range(rng.randrange(1, 30))], np.uint64)
        matched, score, a, b = licenses.align(template, text, 0, 60)
        assert score == full(template.tolist(), text.tolist())
        if score:
            # the span holds an alignment of that score and as many equal words
            assert full(template.tolist(), text[a:b].tolist()) == score and 0 < matched <= min(len(template), b - a)


@pytest.mark.parametrize("name", ["mit-text", "bsd-3-clause-text", "apache-2.0-header", "gpl-3.0-notice", "isc-text", "unlicense-text"])
def test_edited_copies(spark, name):
    rng = random.Random(name)
    words = licenses.TEMPLATES[name].split()
    texts, want = [], []
    for share in (0.0, 0.1, 0.2, 0.5):
        copy = [w if rng.random() >= share else rng.choice(["other", "", "two words"]) for w in words]
        texts.append(" ".join([f"x{rng.randrange(999)}" for _ in range(50)] + [w for w in copy if w] + ["after", "it"]))
        want.append(share <= 0.2)
    got = {r["doc_id"] for r in licenses.scan(frame(spark, texts)).where(f"license = '{name}'").collect()}
    assert got == {i for i, w in enumerate(want) if w}


def test_rows_and_time(spark):
    text = "Released under the MIT License"
    df = spark.createDataFrame([(None, text, "x"), (1, text, "x"), (1, text, "x"), (2, None, "x")], "doc_id long, text string, end string")
    assert sorted((str(r["doc_id"]), r["license"], r["start"], r["end"]) for r in licenses.scan(df).collect()) == [("1", "mit", 0, 30)] * 2 + [("None", "mit", 0, 30)]
    assert licenses.scan(df.where("false")).count() == 0
    notice = licenses.TEMPLATES["gpl-3.0-notice"]
    docs = frame(spark, [(notice + "\n") * 60, "word " * 1_000_000])
    start = time.time()
    got = licenses.scan(docs).where("license = 'gpl-3.0-notice'").collect()
    assert len(got) == 60 and all(r["coverage"] == 1.0 for r in got) and time.time() - start < 20


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "own.txt").write_text("These words are the licence of our house and of no other")
    templates = licenses.read_templates(spark, str(tmp_path))
    got = licenses.scan(frame(spark, ["before. THESE words are the licence of our house and of no other! after", "else"]), templates).collect()
    assert [(r["doc_id"], r["license"], r["coverage"]) for r in got] == [(0, "own", 1.0)]
    with pytest.raises(ValueError):
        licenses.read_templates(spark, str(tmp_path), 10)
