"""Byte-level BPE against the tokenizers library, odd tables and vocabulary files."""

import hashlib
import json
import random

import pytest
from tokenizers import Tokenizer

from palisade.llm import bpe


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")


def test_bpe(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    texts = ["Hello  world's", "", "<|endoftext|> é漢字\n\n 12345", "a" * 300, "\x00 \t x"]
    for r, t in zip(bpe.round_trip(frame(spark, texts), bpe.default_path()).orderBy("doc_id").collect(), texts, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(memoryview(bytes(r["token_ids"])).cast("I")) == ids and r["decoded"] == t


def test_random_texts_against_the_library():
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    rng = random.Random(9)
    pieces = ["the ", "token", "izers", "  ", "\n", "\t\n ", "'ll", "'S", "é", "漢字", "\u0301", "\u200d", "\U0001f600", "123", "4", "<|endoftext|>", "_", "-->", "\x00", "\xa0", "ſ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(1500)] + ["ab" * 4000, "x" * 70_000, " " * 5000]
    for t, packed in zip(texts, own.encode_all(texts), strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(memoryview(packed).cast("I")) == ids and own.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_rows(spark):
    rows = [(None, None, "x"), (1, "twice", "x"), (1, "twice", "x"), (2, "word " * 700_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in bpe.digests(df, bpe.default_path()).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(d, s) for d, _, s in got} == {(None, sha("")), (1, sha("twice")), (2, sha(rows[3][1]))} and len(got) == 3
    assert bpe.digests(df, bpe.default_path()).count() == 4 and bpe.digests(df.where("false"), bpe.default_path()).count() == 0


@pytest.mark.parametrize("change", [lambda d: d["pre_tokenizer"].update(add_prefix_space=True), lambda d: d["model"].update(ignore_merges=True), lambda d: d["added_tokens"][0].update(lstrip=True), lambda d: d["model"]["vocab"].update(zz=1 << 20), lambda d: d.update(normalizer={"type": "NFC"})])
def test_other_vocabularies_are_refused(tmp_path, change):
    spec = json.load(open(bpe.default_path(), encoding="utf-8"))
    change(spec)
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Codec(str(tmp_path / "v.json"))
