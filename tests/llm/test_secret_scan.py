"""Secret scans: base patterns against a plain search, planted secrets, identifiers left alone."""

import hashlib
import random
import re
import time

import pytest

from palisade.llm import secret_scan

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_secrets():
    text = 'é password = "abc" API_KEY: abcdef AKIA' + "Z" * 16 + " " + "0123456789abcdef" * 2 + " auth x9Qz7Lp2Vb8Kt4Wm1Rd6Yn3 ſecret=abcdefg"
    base, every = secret_scan.scan(text)
    assert [(k, text[a:b]) for a, k, b in base] == [("assign", "API_KEY: abcdef"), ("access", "AKIA" + "Z" * 16), ("hex", "0123456789abcdef" * 2)]
    assert ("novel", "x9Qz7Lp2Vb8Kt4Wm1Rd6Yn3") in [(k, text[a:b]) for a, k, b in every]
    assert secret_scan.scan(None) == ([], []) and "abcdef" not in secret_scan.redacted("token=abcdefgh")


@pytest.mark.parametrize("before", ["export AWS_SECRET_ACCESS_KEY=", "private_key=", "auth=", "key auth=user=", "session==", "private key "])
@pytest.mark.parametrize("length", [24, 8000])
def test_secrets_unspaced_and_long(before, length):
    rng = random.Random(length)
    value = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(length))
    text = f"one {before}{value} two"
    (start, kind, end), = secret_scan.scan(text)[1]
    assert kind == "novel" and start <= 4 + len(before) and text[end:] == " two"
    assert value[-12:] not in secret_scan.redacted(text) and value[:12] not in secret_scan.redacted(text)


def plain(text):
    """The base patterns as the contract states them, one kind after the other."""
    kinds = (("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    found = [(m.start(), n, kind, m.end()) for n, (kind, p, group, least) in enumerate(kinds) for m in re.finditer(p, text, re.A) if len(m.group(group)) >= least]
    return [(a, kind, b) for a, _, kind, b in sorted(found)]


def test_base_against_plain_search():
    rng = random.Random(6)
    pieces = ["password", "Api_Key", "TOKEN", "secret", "ſecret", "toKen", "=", ":", " ", "'", '"', "AKIA", "AKIA" + "Q7" * 9, "abc123", "0123456789abcdef" * 2, "é", "x" * 7, "/._-", "\n", "K"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert secret_scan.base_spans(text) == plain(text)


@pytest.mark.parametrize("alphabet", [BASE64, "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789"])
@pytest.mark.parametrize("length", [24, 40, 160])
def test_planted_secrets_are_found(alphabet, length):
    rng = random.Random(length)
    shapes = ["the private key is {} and more", "Authorization: Bearer {}", "export MY_CREDENTIALS={}", "auth_{} end", "url/session/{}", "signature={} x", "key-{}"]
    missed = 0
    for i in range(140):
        value = "".join(rng.choice(alphabet) for _ in range(length))
        if "{}" in (shape := shapes[i % len(shapes)]) and ("_" in shape or "-" in shape or "/session" in shape):
            value = value.replace("/", "7").replace("+", "8")
        text = "some words before, " + shape.format(value) + " and after."
        missed += not any(text[a:b] and value[1:-1] in text[a:b] for a, _, b in secret_scan.scan(text)[1])
    assert missed <= 1


def test_identifiers_are_left_alone():
    texts = ["key: authentication_service_configuration_2", "token /usr/local/lib/python3/site-packages/session", "private static final transaction1transaction1transaction1",
             "no context x9Qz7Lp2Vb8Kt4Wm1Rd6Yn3", "signature_of_the_password_manager_2024_backup", "key zzzzzzzzzzzzzzzzzzzzzzzz1111111111"]
    assert [secret_scan.scan(t)[1] for t in texts] == [[]] * len(texts)
    assert len(secret_scan.scan("auth x9Qz7Lp2Vb8Kt4Wm1Rd6Yn3 then x9Qz7Lp2Vb8Kt4Wm1Rd6Yn3")[1]) == 2


def test_rows(spark):
    long = "key " * 400_000 + "secret=abcdef " + "k" * 500_000 + "=1"
    start = time.time()
    assert len(secret_scan.scan(long)[0]) == 1 and time.time() - start < 10
    rows = [(1, "token=abcdefgh", "x", 5), (1, "token=abcdefgh", "x", 5), (None, None, None, None), (2, "", "y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars int")
    got = secret_scan.digests(df).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 0, 0, hashlib.sha256(b"assign:0:14").hexdigest(), "assign:0:14")] * 2 + [(None, 0, 0, 0, empty, ""), (2, 0, 0, 0, empty, "")], key=str)
    assert sorted(map(tuple, secret_scan.redact(df).collect()), key=str) == sorted([(1, "[secret]", "x", 8)] * 2 + [(None, None, None, None), (2, "", "y", 0)], key=str)
    assert secret_scan.digests(df.where("false")).count() == 0 and secret_scan.redact(df.where("false")).count() == 0 and secret_scan.spans(df).count() == 4
