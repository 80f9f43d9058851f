"""The corpus pipeline: every stage on planted cases, odd rows and an empty table."""

import random

import corpus_pipeline
from palisade.llm import bpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
ITEM = "what is the capital of the small island state named after a volcano answer port marlin bay"


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus():
    rng = random.Random(12)
    english, german = ([f"{a}{b}" for a in x for b in y] for x, y in ((["the", "wa", "stor", "hill"], ["ing", "ter", "ey", "s", "tion"]), (["der", "sch", "wie", "zung"], ["ung", "lich", "ä", "en", "ß"])))
    rows = [(i, prose(rng, english if i % 2 else german, 60), "en" if i % 2 else "de", "web", 1) for i in range(200)]
    rows += [(300, rows[7][1], "en", "copy", 1), (301, rows[7][1] + " end", None, "near copy", 1), (302, "12 345 !", None, "no letters", 1), (303, None, None, None, None), (304, "", "en", "empty", 0),
             (305, prose(rng, english, 40) + " " + ITEM.upper() + " " + prose(rng, english, 40), None, "leak", 1), (306, prose(rng, english, 40) + " password=hunter2222 and more", None, "secret", 1),
             (307, rows[9][1] + " q", "en", "twice", 1), (307, rows[9][1] + " q", "en", "twice", 1), (None, prose(rng, english, 50), "en", "nameless", 1)]
    return rows


def test_stages(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(200)) - {9}
    assert {302, 303, 304} & set(seen["language_id"]) == set() and clean | {None, 301, 305, 306, 307} <= set(seen["language_id"])
    assert {300, 301, 307} & set(seen["near_dedup"]) == set() and clean | {None, 9, 305, 306} == set(seen["near_dedup"])
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {305}
    assert set(seen["secrets"]) == set(seen["decontamination"]) == set(seen["bpe"])
    text = seen["secrets"][306]["text"]
    assert "hunter2222" not in text and "[secret]" in text and seen["secrets"][306]["n_chars"] == len(text)
    codec = bpe.codec(bpe.default_path())
    for d, r in seen["bpe"].items():
        assert codec.decode(bytes(r["token_ids"])) == seen["secrets"][d]["text"] and r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) // 4
    whole = {r["doc_id"]: bytes(r["token_ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {d: bytes(r["token_ids"]) for d, r in seen["bpe"].items()}


def test_empty_and_unlabelled(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, "some words of no known language", None, None, None), (1, "other words of no known language either", None, None, None), (None, None, None, None, None)], SCHEMA)
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
    assert docs.count() == 1
