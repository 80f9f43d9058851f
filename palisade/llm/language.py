"""Language identification by string kernels.

The kernel of two texts is the mean, over n = 1..4, of the cosine between their
presence vectors of byte n-grams (letters folded, other ASCII a blank, hashed into a
fixed number of buckets): a normalised blended-spectrum presence kernel. Nystroem
landmarks, drawn from the training rows, stand for the whole kernel matrix, and
one-versus-rest kernel ridge regression on them gives one weight per landmark and
language. Because the kernel is a sum of inner products, landmarks times weights is
one matrix per n, and a batch of texts is scored by four matrix products.

Training rows are a bounded sample: at most ``rows`` whole texts in all, so at most
``per_language`` and the same number for each language, with ``characters`` together at
most for each language (one text at least); those of at most ``longest`` characters come
first, then by the lowest hash of doc_id. All languages are learned, ``languages`` at most
(more are refused, not cut). Every text is scored whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; without
training rows everything is ``und``; equal texts get equal answers; ties go to the
alphabetically first language; repeated rows and null ids are rows like others; an empty
table gives no rows; a very long text is scored in a run of its own. Columns of the input
that clash with an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import fresh
from .textvec import map_rows, utf8

BITS = (8, 12, 14, 15)
_STARTS = np.concatenate([[0], np.cumsum([1 << b for b in BITS])])
PER_LANGUAGE, ROWS, LANGUAGES, LANDMARKS, LONGEST, CHARACTERS, RIDGE, SHARPNESS = 300, 30_000, 2000, 256, 20_000, 3_000_000, 1e-3, 8.0
# Texts are rejected below the score that this share of rightly answered held-out rows, LEAST_ROWS at least, falls short of.
# ... but never above what is nearly undecided: this share of the way from even chances to certainty.
REJECTED, LEAST_ROWS, UNDECIDED = 1e-4, 30, 0.2
_ROWS = 96

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER = regex.compile(r"\p{L}")


def presence(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: which hashed n-grams occur in it."""
    n = len(offsets) - 1
    width = int(_STARTS[-1])
    out = np.zeros((n, width), np.uint8)
    flat = out.reshape(-1)
    text = _FOLD[buf].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64) * width, np.diff(offsets))
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(buf))
    code = np.zeros(len(buf), np.uint32)
    for k, bits in enumerate(BITS):
        size = len(buf) - k
        if size <= 0:
            break
        code = (code[:size] << np.uint32(8)) | text[k:]
        slot = code if bits == 8 else (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        at = row[:size] + (int(_STARTS[k]) + slot.astype(np.int64))
        flat[at if k == 0 else at[room[:size] > k]] = 1
    return out


def _blocks(seen: np.ndarray):
    """For each n the presence as floats, divided by its length."""
    for k in range(len(BITS)):
        block = seen[:, _STARTS[k] : _STARTS[k + 1]].astype(np.float32)
        yield k, block / np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1))


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The kernel matrix of two presence matrices."""
    left, right = _blocks(a), _blocks(b)
    return sum(x @ y.T for (_, x), (_, y) in zip(left, right, strict=True)) / len(BITS)


class Model:
    """Languages and, for each n, the matrix that turns presence into their scores."""

    def __init__(self, labels: list[str], weights: list[np.ndarray]):
        self.labels, self.weights = labels, weights

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(block @ self.weights[k] for k, block in _blocks(seen))


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """A model of (text, language) rows; landmarks are spread evenly over the languages."""
    labels = sorted({lang for _, lang in rows})
    if not labels:
        return Model([], [])
    place = {lang: i for i, lang in enumerate(labels)}
    own: dict[str, int] = {}
    quota, chosen = -(-landmarks // len(labels)), []
    for i, (_, lang) in enumerate(rows):
        own[lang] = own.get(lang, 0) + 1
        if own[lang] <= quota:
            chosen.append(i)

    def seen(part: list[int]) -> np.ndarray:
        return presence(*utf8(pa.array([rows[i][0] for i in part], pa.string())))

    marks = np.concatenate([seen(chosen[a : a + _ROWS]) for a in range(0, len(chosen), _ROWS)])
    inner = kernel(marks, marks)
    gram = ridge * len(rows) * inner.astype(np.float64)
    target = np.zeros((len(chosen), len(labels)))
    for a in range(0, len(rows), _ROWS):
        part = list(range(a, min(a + _ROWS, len(rows))))
        block = kernel(seen(part), marks).astype(np.float64)
        y = np.zeros((len(part), len(labels)))
        y[np.arange(len(part)), [place[rows[i][1]] for i in part]] = 1
        gram += block.T @ block
        target += block.T @ y
    alpha = np.linalg.solve(gram + 1e-6 * np.trace(gram) / len(gram) * np.eye(len(gram)), target).astype(np.float32)
    return Model(labels, [(block.T @ alpha) / np.float32(len(BITS)) for _, block in _blocks(marks)])


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES, longest: int = LONGEST, rows: int = ROWS, characters: int = CHARACTERS,
          text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fit on a bounded, hash-ordered sample of ``labelled`` rows."""
    known = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(key)).alias("h")).where("l IS NOT NULL AND length(t) > 0")
    counts = known.groupBy("l").count().limit(languages + 1).collect()
    if not counts:
        return Model([], [])
    if len(counts) > languages:
        raise ValueError(f"more than {languages} languages")
    most = max(1, min(per_language, rows // len(counts)))
    # three times the rows wanted, as the hash is only roughly even and long texts come last
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, 3.0 * most / r["count"] + 30.0 / r["count"]))])
    unit = F.pmod(F.col("h"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = known.where(unit < F.element_at(share, F.col("l"))).withColumn("long", F.length("t") > longest)
    order = Window.partitionBy("l").orderBy("long", "h", "t")
    kept = drawn.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    so_far = F.sum(F.length("t")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("c", so_far).where((F.col("n") == 1) | (F.col("c") <= characters))
    return fit([(r["t"], r["l"]) for r in kept.orderBy("n", "l").collect()])


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language of every whole text and its score from 0 to 1."""

    def make(part: pa.RecordBatch):
        texts = part.column("s0")
        buf, offsets = utf8(texts)
        letter = np.zeros(len(texts), bool)
        folded = _FOLD[buf]
        for i in range(len(texts)):
            row = folded[offsets[i] : offsets[i + 1]]
            letter[i] = bool(len(row)) and bool(((row > 0x60) & (row < 0x7B)).any() or ((row > 0x7F).any() and _LETTER.search(texts[i].as_py())))
        if not model.labels:
            return ["und"] * len(texts), [0.0] * len(texts)
        raw = model.scores(presence(buf, offsets)).astype(np.float64)
        best = raw.argmax(axis=1)
        soft = np.exp(SHARPNESS * (raw - raw.max(axis=1, keepdims=True)))
        sure = 1 / soft.sum(axis=1)
        return [model.labels[b] if ok else "und" for b, ok in zip(best, letter, strict=True)], np.where(letter, sure, 0.0)

    keep = [c for c in df.columns if c not in (lang_pred, score)]
    return map_rows(df, keep, [text], {lang_pred: T.StringType(), score: T.DoubleType()}, make, 1 << 19, _ROWS)


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key's text modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % folds


def held_out_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; held-out rows train nothing."""
    held = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def least_score(docs: DataFrame, rejected: float = REJECTED, least_rows: int = LEAST_ROWS) -> float:
    """The score that a share ``rejected`` of rightly answered held-out rows falls short of, or what is nearly undecided if that is less; 0 if fewer than ``least_rows`` are at hand."""
    held = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held))
    if len(model.labels) < 2:
        return 0.0
    tested = predict(docs.where(held & F.col("lang").isNotNull()).select("text", "lang"), model)
    found = tested.where(F.col("lang_pred") == F.col("lang")).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", rejected, 10_000).alias("low")).first()
    even = 1 / len(model.labels)
    return min(float(found["low"]), even + UNDECIDED * (1 - even)) if found["n"] >= least_rows else 0.0


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents of which no language can be told.

    Those are null texts, texts without a letter, and texts that the model scores below
    ``least_score``. Where no language is learned, every text with a letter stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    model = train(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*columns)
    least = least_score(docs)
    told, score = fresh("told", docs.columns), fresh("sure", docs.columns)
    return predict(docs, model, lang_pred=told, score=score).where((F.col(told) != "und") & (F.col(score) >= least)).select(*columns)
