"""Language identification against plain string kernels, on held-out rows and odd tables."""

import numpy as np
import pyarrow as pa
import pytest

from palisade.llm import language
from palisade.llm.textvec import utf8


def test_language(spark):
    rows = [(i, " ".join(("the house and water" if i % 2 else "das haus und wasser").split() * (1 + i % 3)), "en" if i % 2 else "de") for i in range(60)] + [(60, None, "en"), (61, "123 !!", "de")]
    got = {r["doc_id"]: r for r in language.held_out_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(60)) and got[60]["lang_pred"] == got[61]["lang_pred"] == "und"


def test_language_stage(spark):
    schema = "doc_id long, text string, lang string"
    unlabelled = spark.createDataFrame([(0, "the house", None), (1, "12 !", None), (2, None, None), (3, "漢字", None)], schema)
    assert sorted(r["doc_id"] for r in language.identified(unlabelled).collect()) == [0, 3]
    rows = [(i, " ".join(("the house and water of this town" if i % 2 else "das haus und wasser in der stadt").split() * (2 + i % 3)), "en" if i % 2 else "de") for i in range(200)]
    rows += [(200, "q", None), (201, "xq zj kv wp", None), (202, None, "en")]
    assert sorted(r["doc_id"] for r in language.identified(spark.createDataFrame(rows, schema)).collect()) == list(range(200))
    named = spark.createDataFrame(rows, schema).selectExpr("*", "'mine' AS _lang_pred", "'own' AS _score", "'a' AS told", "'b' AS sure")
    kept = language.identified(named)
    assert kept.columns == named.columns and {tuple(r)[3:] for r in kept.collect()} == {("mine", "own", "a", "b")} and kept.count() == 200


def plain_kernel(a, b):
    """Mean over n of the cosine of the presence of n-grams, without hashing."""
    def grams(t, n):
        folded = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in t.lower().encode())
        return {folded[i : i + n] for i in range(len(folded) - n + 1)}

    out = 0.0
    for n in range(1, 5):
        x, y = grams(a, n), grams(b, n)
        out += len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1))
    return out / 4


TEXTS = ["the house and the water", "das haus und das wasser", "la maison et l'eau claire", "é è ê", "abc", "Ab", "x", "the water 12 und", "un the das"]


def test_kernel_against_sets():
    seen = language.presence(*utf8(pa.array(TEXTS)))
    got = language.kernel(seen, seen)
    want = np.array([[plain_kernel(a, b) for b in TEXTS] for a in TEXTS])
    assert np.abs(got - want).max() < 0.02


def test_ridge_solution():
    rows = [(t, "xyz"[i % 3]) for i, t in enumerate(TEXTS * 3)]
    model = language.fit(rows, landmarks=6, ridge=1e-2)
    seen = language.presence(*utf8(pa.array([t for t, _ in rows])))
    place = {n: [i for i, (_, x) in enumerate(rows) if x == n][:2] for n in "xyz"}
    marks = seen[sorted(i for x in place.values() for i in x)]
    k, inner = language.kernel(seen, marks).astype(float), language.kernel(marks, marks).astype(float)
    y = np.array([[float(x == n) for n in "xyz"] for _, x in rows])
    gram = k.T @ k + 1e-2 * len(rows) * inner
    alpha = np.linalg.solve(gram + 1e-6 * np.trace(gram) / len(gram) * np.eye(len(gram)), k.T @ y)
    assert np.abs(model.scores(seen) - k @ alpha).max() < 1e-3


def test_rows_ties_and_many_languages(spark):
    schema = "doc_id long, text string, lang string, lang_pred int"
    rows = [(i, f"{'abcdefghij'[i % 10] * 3} {'klmnopqrst'[i % 10] * 4} word", f"l{i % 10:02d}", 1) for i in range(400)]
    rows += [(None, rows[0][1], None, 1), (None, None, None, 1), (5, rows[0][1], None, 1), (5, rows[0][1], None, 1), (6, "long text " * 300_000, None, 1), (7, "uuu vvv " * 9_000, "only long", 1), (8, "uuu vvv", None, 1)]
    df = spark.createDataFrame(rows, schema)
    got = language.predict(df, language.train(df.where("doc_id IS NULL OR doc_id % 4 <> 2"))).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == f"l{r['doc_id'] % 10:02d}" for r in got if r["lang"] and r["lang"] != "only long")
    same = {r["lang_pred"] for r in got if r["text"] == rows[0][1]}
    assert same == {"l00"} and {r["lang_pred"] for r in got if (r["text"] or "").startswith("uuu")} == {"only long"}
    assert [r["lang_pred"] for r in got if r["text"] is None] == ["und"]
    with pytest.raises(ValueError):
        language.train(df, languages=5)
    empty = df.where("false")
    assert language.held_out_languages(empty).count() == 0 and language.identified(empty).count() == 0


def test_tie_is_the_first_language():
    model = language.Model(["a", "b"], [np.zeros((1 << n, 2), np.float32) for n in language.BITS])
    assert model.scores(language.presence(*utf8(pa.array(["text"])))).argmax() == 0
