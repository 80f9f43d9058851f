"""License texts in documents: winnowed fingerprints pick candidates, banded alignment confirms.

Templates (name and text; a parameter) are cut into runs of ``GRAM`` words, A-Z folded
and punctuation dropped. Of every ``WINDOW`` adjacent runs the smallest hash is a
fingerprint, in templates and documents alike, so any common stretch of GRAM + WINDOW - 1
words shares one. An inverted index of the templates' fingerprints finds, for each
document, templates and diagonals; a local alignment of words in a band around each
diagonal reports how much of the template is matched and where.

Defined cases: null and empty texts match nothing; equal texts match equally, repeated
rows and rows without an id like others; overlapping matches of one template are reported
once, the one covering most (then the first); a match is reported from ``LEAST_COVERAGE``
of the template on; an empty table gives no rows; very long texts are scanned whole, in a
run of their own; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .license_texts import TEMPLATES
from .textvec import shingles, slices, utf8, words

GRAM, WINDOW, BAND, LEAST_COVERAGE = 3, 2, 8, 0.7
_KEEP = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _KEEP[_a:_b] = np.arange(_a, _b)

def winnow(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of rows of words: (hash, word index of its run), runs not crossing rows."""
    grams, at = shingles(hashes, rows, GRAM)
    counts = np.diff(at)
    place = np.repeat(rows[:-1] - at[:-1], counts) + np.arange(len(grams))
    last = np.repeat(at[1:], counts)
    chosen = np.zeros(len(grams), bool)
    best, where = grams.copy(), np.arange(len(grams))
    for j in range(1, WINDOW):
        inside = np.arange(len(grams)) + j < last
        after = np.minimum(np.arange(len(grams)) + j, max(len(grams) - 1, 0))
        lower = inside & (grams[after] <= best)
        best, where = np.where(lower, grams[after], best), np.where(lower, after, where)
    whole = np.arange(len(grams)) + WINDOW <= np.maximum(last, np.repeat(at[:-1], counts) + WINDOW)
    chosen[where[whole]] = True
    chosen = np.flatnonzero(chosen)
    return grams[chosen], place[chosen]


def tokens(buf: np.ndarray, offsets: np.ndarray):
    return words(_KEEP[buf], offsets)


class Index:
    """The templates' words and the inverted index of their fingerprints."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        hashes, _, _, rows = tokens(*utf8(pa.array([templates[n] for n in self.names], pa.string())))
        self.words = [hashes[rows[i] : rows[i + 1]] for i in range(len(self.names))]
        prints, place = winnow(hashes, rows)
        row = np.searchsorted(rows, place, side="right") - 1
        order = np.argsort(prints, kind="stable")
        self.prints, self.row, self.place = prints[order], row[order], (place - rows[row])[order]


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int, int]:
    """Words matched by the best local alignment within ``band`` of diagonal ``shift``, its score, first and end word in ``text``.

    A match scores 2, a different, missing or added word -1; a row of the band at a time.
    """
    width = 2 * band + 1
    steps = np.arange(width)
    padded = np.zeros(len(text) + 2, text.dtype)
    padded[1:-1] = text
    above, kinds = np.zeros(width + 1, np.int64), np.zeros((len(template), width), np.int8)
    best, at = 0, (0, 0)
    for i in range(len(template)):
        j = i + shift - band + steps
        inside = (j >= 0) & (j < len(text))
        same = (padded[np.clip(j + 1, 0, len(text) + 1)] == template[i]) & inside
        across, down = above[:-1] + np.where(same, 2, -1), above[1:] - 1
        first = np.where(inside, np.maximum(np.maximum(across, down), 0), 0)
        row = np.where(inside, np.maximum.accumulate(first + steps) - steps, 0)
        kinds[i] = np.where(row <= 0, 0, np.where(row == across, np.where(same, 1, 2), np.where(row == down, 3, 4)))
        above[:-1] = row
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), (i, top)
    if not best:
        return 0, 0, 0, 0
    i, b = at
    end, matched = i + shift - band + b + 1, 0
    while i >= 0 and 0 <= b < width and (kind := kinds[i, b]):
        matched += kind == 1
        if kind == 4:
            b -= 1
        else:
            i, b = i - 1, b + (kind == 3)
    # after a step across or down the start is the word after the cell that scored nothing
    return int(matched), best, i + shift - band + b + 1, end


def matches(text_words: np.ndarray, index: Index, found: list[tuple[int, int, int]], least: float) -> list[tuple[int, float, int, int]]:
    """(template, coverage, first word, end word) in one text; ``found``: (template, its word, the text's word)."""
    out: list[tuple[int, float, int, int]] = []
    diagonals: dict[int, dict[int, int]] = {}
    for t, at, place in found:
        own = diagonals.setdefault(t, {})
        own[(place - at) // BAND] = own.get((place - at) // BAND, 0) + 1
    for t, seen in sorted(diagonals.items()):
        template, own = index.words[t], []
        # a copy that covers enough leaves at least one fingerprint, and long ones several, near its diagonal
        enough = max(1, int(least * len(template) / (GRAM + WINDOW) / 8))
        for diagonal in sorted(d for d in seen if sum(seen.get(d + k, 0) for k in (-2, -1, 0, 1, 2)) >= enough):
            shift = diagonal * BAND + BAND // 2
            low = max(0, shift - 2 * BAND)
            # what is left and right of a match may hold another one
            parts = [(low, min(len(text_words), max(0, shift) + len(template) + 2 * BAND))]
            while parts:
                begin, end = parts.pop()
                if end - begin < least * len(template):
                    continue
                matched, _, a, b = align(template, text_words[begin:end], shift - begin, 2 * BAND)
                if matched and matched >= least * len(template):
                    own.append((t, matched / len(template), begin + a, begin + b))
                    parts += [(begin, begin + a), (begin + b, end)]
        starts: list[int] = []  # of what is taken, in order: nothing taken overlaps
        taken: list[tuple[int, float, int, int]] = []
        for m in sorted(set(own), key=lambda x: (-x[1], x[2])):
            k = bisect_left(starts, m[3])
            if not k or taken[k - 1][3] <= m[2]:
                starts.insert(k, m[2])
                taken.insert(k, m)
        out += taken
    return out


def read_templates(spark: SparkSession, path: str, most_bytes: int = 8 << 20) -> dict[str, str]:
    """Templates from a folder of text files, by file name; refused if larger than tasks should hold."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1).alias("name"), "value")
    size = rows.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of templates, {most_bytes} at most")
    return {r["name"]: r["value"] for r in rows.collect()}


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = LEAST_COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, license, coverage, start and end (code points) of every match."""
    schema = T.StructType([docs.schema[key], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            for part in slices(batch, "text"):
                buf, offsets = utf8(part.column("text"))
                hashes, first, last, rows = tokens(buf, offsets)
                prints, place = winnow(hashes, rows)
                low, high = np.searchsorted(index.prints, prints), np.searchsorted(index.prints, prints, side="right")
                by_row: dict[int, list[tuple[int, int, int]]] = {}
                for h in np.flatnonzero(high > low).tolist():
                    r = int(np.searchsorted(rows, place[h], side="right") - 1)
                    by_row.setdefault(r, []).extend((int(index.row[e]), int(index.place[e]), int(place[h] - rows[r])) for e in range(low[h], high[h]))
                picked, out = [], []
                for r, found in sorted(by_row.items()):
                    raw = buf[offsets[r] : offsets[r + 1]].tobytes()
                    for t, coverage, a, b in matches(hashes[rows[r] : rows[r + 1]], index, found, least):
                        start, end = (len(raw[: x - offsets[r]].decode()) for x in (first[rows[r] + a], last[rows[r] + b - 1]))
                        picked.append(r)
                        out.append((index.names[t], coverage, start, end))
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(picked, pa.int64())), *(pa.array([o[c] for o in out], k) for c, k in enumerate(kinds))], names=schema.names)

    return docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text")).mapInArrow(run, schema)
