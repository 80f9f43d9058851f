"""Benchmark decontamination by latent semantic retrieval.

Words are runs of letters and digits in lower case. The vocabulary is that of the items
and the ``CORPUS_WORDS`` words that most documents have, so words which stand beside the
items' words have places in the latent space too. TF-IDF vectors of all passages of
``PASSAGE`` words feed a distributed randomised decomposition: one pass sums A'AW over all
passages, where W spans random mixtures of the items' windows and random directions, and
the Nystroem form of that sketch gives the singular vectors.

A stretch of a document and an item are compared if enough of the item's words stand
there: an inverted index of the items' words counts them, by the measure that acceptance
uses, so nothing that could be accepted is left out. Of those stretches, the ones with a
window whose cosine with a window of the item reaches ``LEAST_COSINE`` in the whitened
latent space go to the longest common subsequence of words, and for paraphrases also to
the answer check: the item's last words must be there.

Documents are coded and gone through once for all items, up to ``BLOCK_WORDS`` words of
items (some ten thousand items); larger benchmarks are handled so many words at a time.
What is sent to tasks, and each task's part of the sketch (``TERMS`` rows at most, rarer
words share rows), is bounded by that.

Defined cases: null and empty texts match nothing; an item without words matches
nothing; repeated rows match alike; items with one item_id are separate texts and the
best match counts, of equal ones the first; a null doc_id or item_id is reported as it is;
empty tables give no rows; very long texts are gone through whole, in a run of their own;
other columns are not looked at, and ``decontaminate`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bits import bit_map, flagged, fresh
from .licenses import tokens
from .staging import stage
from .textvec import map_rows, slices, utf8

PASSAGE, WIDTH, STRIDE = 256, 24, 8
MIXTURES, RANDOM = 96, 32
CORPUS_WORDS, TERMS, BLOCK_WORDS = 2048, 1 << 15, 1 << 20
COMMON_SHARE, COMMON_LEAST, RARE_LEAST = 0.1, 8, 3
LEAST_COSINE = 0.25
LEAST_COVERAGE, PARAPHRASE_COVERAGE, ANSWER_SHARE = 0.7, 0.55, 0.25
OTHER = 0xFFFFFFFF
_SLOTS = 1 << 20
LEAK = "doc_id long, item_id long, coverage double, answer boolean, at int"


def frequent_words(docs: DataFrame, most: int = CORPUS_WORDS) -> np.ndarray:
    """Hashes of the words that most documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, inverse = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return words, np.bincount(inverse, np.concatenate([n for _, n in held]), len(words)).astype(np.int64)

        def rows(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                hashes, _, _, at = tokens(*utf8(pc.utf8_lower(part.column("text"))))
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                order = np.argsort(hashes, kind="stable")
                h, r = hashes[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                once = new.copy()
                once[1:] |= r[1:] != r[:-1]
                held.append((h[new], np.diff(np.concatenate([np.flatnonzero(new[once]), [int(once.sum())]]))))
                if sum(len(x) for x, _ in held) > 1 << 20:
                    held = [merged()]
                    if len(held[0][0]) > 1 << 19:
                        yield rows(*held[0])
                        held = []
        if held:
            yield rows(*merged())

    found = docs.select("text").where("text IS NOT NULL").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most)
    return np.array([r["h"] for r in found.collect()], np.int64).view(np.uint64)


class Benchmark:
    """Some items as word codes, with an inverted index of the words that tell of them."""

    def __init__(self, rows: list[tuple[int | None, str]], frequent: np.ndarray):
        self.ids = [i for i, _ in rows]
        hashes, _, _, at = tokens(*utf8(pc.utf8_lower(pa.array([t for _, t in rows], pa.string()))))
        self.vocabulary = np.unique(np.concatenate([hashes, frequent]))
        self.items = [np.searchsorted(self.vocabulary, hashes[at[i] : at[i + 1]]) for i in range(len(rows))]
        self.slots = np.zeros(_SLOTS, bool)
        self.slots[(self.vocabulary & np.uint64(_SLOTS - 1)).astype(np.int64)] = True
        size = len(self.vocabulary)
        kinds = [np.unique(x) for x in self.items]
        common = np.bincount(np.concatenate([*kinds, np.zeros(0, np.int64)]), minlength=size) > max(COMMON_LEAST, COMMON_SHARE * len(rows))
        lengths = np.array([len(x) for x in self.items], np.int64)
        self.reach = lengths + lengths // 2
        # what an accepted stretch must have, if every common word were there
        self.need = np.ceil(PARAPHRASE_COVERAGE * lengths - 1e-9).astype(np.int64)
        pairs = []
        for k, (item, own) in enumerate(zip(self.items, kinds, strict=True)):
            rare = self.need[k] - int(common[item].sum())
            if rare >= RARE_LEAST:
                self.need[k], own = rare, own[~common[own]]
            pairs.append(np.stack([own, np.full(len(own), k)]))
        word, item = np.concatenate([*pairs, np.zeros((2, 0), np.int64)], axis=1)
        order = np.argsort(word, kind="stable")
        self.post = item[order]
        self.post_at = np.searchsorted(word[order], np.arange(size + 1))
        # windows of the items; rarer words share rows of the latent space
        self.terms = min(size, TERMS)
        windows, self.of = [], []
        for k, item in enumerate(self.items):
            starts = sorted({*range(0, max(1, len(item) - WIDTH + 1), WIDTH), max(0, len(item) - WIDTH)})
            windows += [item[s : s + WIDTH] for s in starts]
            self.of += [k] * len(starts)
        self.windows = windows

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of word hashes, ``OTHER`` where there is none."""
        out = np.full(len(hashes), OTHER, np.uint32)
        maybe = np.flatnonzero(self.slots[(hashes & np.uint64(_SLOTS - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            same = self.vocabulary[at] == hashes[maybe]
            out[maybe[same]] = at[same]
        return out


def coded(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """doc_id, codes: packed word codes of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(bench)

    def make(part: pa.RecordBatch):
        hashes, _, _, at = tokens(*utf8(pc.utf8_lower(part.column("s0"))))
        codes = shared.value.code(hashes)
        return ([codes[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)],)

    return map_rows(docs, ["doc_id"], ["text"], {"codes": T.BinaryType()}, make)


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of documents with their codes, concatenated, and the documents' bounds."""
    for batch in batches:
        raw = batch.column("codes")
        sizes = np.array([len(x) // 4 for x in raw.to_pylist()], np.int64)
        total, start = np.concatenate([[0], np.cumsum(sizes)]), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(total, total[start] + most, side="right")) - 1)
            part = batch.slice(start, stop - start)
            codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint32)
            yield part, codes, total[start : stop + 1] - total[start]
            start = stop


def _entries(codes: np.ndarray, at: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Passage, term and count of the passages of ``codes``; and the number of passages."""
    lengths = np.diff(at)
    made = -(-lengths // PASSAGE)
    first = np.concatenate([[0], np.cumsum(made)])
    place = np.arange(len(codes)) - np.repeat(at[:-1], lengths)
    passage = np.repeat(first[:-1], lengths) + place // PASSAGE
    known = codes != OTHER
    keyed, n = np.unique(passage[known] * terms + codes[known] % terms, return_counts=True)
    return keyed // terms, keyed % terms, n, int(first[-1])


def _summed(df: DataFrame, size: int, block: int = 1 << 15) -> np.ndarray:
    """The sum of the float arrays that tasks emitted as (block, values) rows; blocks are summed by key, in streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        mark = None
        for batch in batches:
            for b, v in zip(batch.column("block").to_pylist(), batch.column("values").to_pylist(), strict=True):
                if mark is not None and b != mark:
                    yield pa.RecordBatch.from_arrays([pa.array([mark], pa.int64()), pa.array([held.pop(mark).astype(np.float32).tobytes()], pa.binary())], names=["block", "values"])
                mark = b
                part = np.frombuffer(v, np.float32).astype(np.float64)
                held[b] = held[b] + part if b in held else part
        if mark is not None:
            yield pa.RecordBatch.from_arrays([pa.array([mark], pa.int64()), pa.array([held[mark].astype(np.float32).tobytes()], pa.binary())], names=["block", "values"])

    rows = df.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, values binary").collect()
    out = np.zeros(size)
    for r in rows:
        part = np.frombuffer(bytes(r["values"]), np.float32)
        out[r["block"] * block : r["block"] * block + len(part)] = part
    return out


def _emit(total: np.ndarray, block: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    flat = np.ascontiguousarray(total, np.float32).reshape(-1)
    for b in range(0, len(flat), block):
        yield pa.RecordBatch.from_arrays([pa.array([b // block], pa.int64()), pa.array([flat[b : b + block].tobytes()], pa.binary())], names=["block", "values"])


def term_weights(codes: DataFrame, terms: int) -> np.ndarray:
    """Inverse passage frequency of each term over all passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 1)
        for _, words, at in _batches(batches):
            _, term, _, n = _entries(words, at, terms)
            total[:terms] += np.bincount(term, minlength=terms)
            total[terms] += n
        yield from _emit(total)

    found = _summed(codes.mapInArrow(run, "block long, values binary"), terms + 1)
    return np.log((found[terms] + 1) / (found[:terms] + 1)) + 1


def latent_space(codes: DataFrame, weights: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Whitened right singular vectors (terms x rank) of all TF-IDF passages.

    ``directions`` (terms x rank, orthonormal) are those of the single-pass sketch.
    """
    size, width = directions.shape
    sent = codes.sparkSession.sparkContext.broadcast((weights.astype(np.float32), directions.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, aim = sent.value
        total = np.zeros((size, width), np.float32)
        for _, words, at in _batches(batches):
            passage, term, n, count = _entries(words, at, size)
            value = (1 + np.log(n)).astype(np.float32) * weight[term]
            norm = np.sqrt(np.bincount(passage, value.astype(np.float64) ** 2, count))
            value /= norm[passage].astype(np.float32)
            for low in range(0, count, 256):
                a, b = np.searchsorted(passage, [low, low + 256])
                if a == b:
                    continue
                # only the terms that these passages have
                own, column = np.unique(term[a:b], return_inverse=True)
                dense = np.zeros((min(256, count - low), len(own)), np.float32)
                dense[passage[a:b] - low, column] = value[a:b]
                total[own] += dense.T @ (dense @ aim[own])
        yield from _emit(total)

    sketch = _summed(codes.mapInArrow(run, "block long, values binary"), size * width).reshape(size, width)
    sketch = sketch + 1e-7 * max(np.linalg.norm(sketch), 1e-12) * directions
    middle = directions.T @ sketch
    lower = np.linalg.cholesky((middle + middle.T) / 2 + 1e-7 * max(np.trace(middle), 1e-12) / width * np.eye(width))
    left, s, _ = np.linalg.svd(np.linalg.solve(lower, sketch.T).T, full_matrices=False)
    keep = s > 1e-4 * s[0]
    return left[:, keep] / np.maximum(s[keep], 1e-2 * s[0])


def lcs(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence with the item whose word positions are ``masks``."""
    full = (1 << length) - 1
    row = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            both = row & m
            row = ((row + both) | (row - both)) & full
    return length - row.bit_count()


def leaks(docs: DataFrame, benchmark: DataFrame, least_cosine: float = LEAST_COSINE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, coverage, answer and at (word) of every document that holds a benchmark item."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    # a word has two bytes with the blank after it
    sized = stage(items.withColumn("size", F.octet_length("text") / 2), "items")
    blocks = max(1, int(-(-(sized.agg(F.sum("size")).first()[0] or 0) // block_words)))
    frequent, found = None, None
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]
        if not rows:
            continue
        frequent = frequent_words(plain) if frequent is None else frequent
        bench = Benchmark(rows, frequent)
        if any(len(x) for x in bench.items):
            part = _leaks(plain, bench, least_cosine)
            found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], LEAK)
    best = F.max(F.struct("coverage", "answer", (-F.col("at")).alias("at")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.coverage", "b.answer", (-F.col("b.at")).alias("at"))


def aims_of(bench: Benchmark, codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places in the latent space of the terms (and a zero row for other words) and, normed, of the items' windows."""
    weights = term_weights(codes, bench.terms)
    rng = np.random.default_rng(5)
    vectors = np.zeros((len(bench.windows), bench.terms), np.float32)
    for k, window in enumerate(bench.windows):
        np.add.at(vectors[k], window % bench.terms, 1)  # plain counts, as windows are sums of words
    vectors *= weights[None, :].astype(np.float32)
    norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    mixed = (vectors / norms).T @ rng.standard_normal((len(vectors), min(MIXTURES, len(vectors)))).astype(np.float32)
    random = rng.standard_normal((bench.terms, min(RANDOM, bench.terms)))
    directions, upper = np.linalg.qr(np.concatenate([mixed.astype(np.float64), random], axis=1))
    independent = np.abs(np.diag(upper)) > 1e-6 * np.abs(np.diag(upper)).max()
    space = latent_space(codes, weights, directions[:, : len(independent)][:, independent])
    terms = np.concatenate([weights[:, None] * space, np.zeros((1, space.shape[1]))]).astype(np.float32)
    aims = vectors @ space.astype(np.float32)
    return terms, aims / np.maximum(np.linalg.norm(aims, axis=1, keepdims=True), 1e-12)


def stretches(bench: Benchmark, words: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, first word, end word) of every stretch that has as many of an item's words as an accepted one must have."""
    lengths = np.diff(at)
    base = np.concatenate([[0], np.cumsum(-(-lengths // STRIDE))])
    chunks = int(base[-1])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    chunk = base[doc] + (np.arange(len(words)) - at[doc]) // STRIDE
    known = np.flatnonzero(words != OTHER)
    known = known[bench.post_at[words[known] + 1] > bench.post_at[words[known]]]
    low, n = bench.post_at[words[known]], bench.post_at[words[known] + 1] - bench.post_at[words[known]]
    which = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)
    keys, counts = np.unique(bench.post[which] * chunks + np.repeat(chunk[known], n), return_counts=True)
    if not len(keys):
        return
    item, first = keys // chunks, keys % chunks
    lag = -(-bench.reach[item] // STRIDE) + 1
    end = base[np.searchsorted(base, first, side="right")]
    total = np.concatenate([[0], np.cumsum(counts)])
    held = total[np.searchsorted(keys, item * chunks + np.minimum(first + lag, end))] - total[:-1]
    last = None
    for k in [*np.flatnonzero(held >= bench.need[item]).tolist(), -1]:
        own = (int(item[k]), int(end[k])) if k >= 0 else None
        if last and own == last[0] and first[k] <= last[2]:
            last = (own, last[1], int(first[k] + lag[k]))
            continue
        if last:
            d = int(np.searchsorted(base, last[1], side="right")) - 1
            yield d, last[0][0], (last[1] - int(base[d])) * STRIDE, min((last[2] - int(base[d])) * STRIDE, int(lengths[d]))
        last = (own, int(first[k]), int(first[k] + lag[k])) if k >= 0 else None


def _leaks(docs: DataFrame, bench: Benchmark, least_cosine: float) -> DataFrame:
    codes = stage(coded(docs, bench), "codes")
    terms, aims = aims_of(bench, codes)
    bounds = np.searchsorted(bench.of, np.arange(len(bench.items) + 1))
    sent = docs.sparkSession.sparkContext.broadcast((bench, terms, aims, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, terms, aims, bounds = sent.value
        masks: dict[int, tuple[dict[int, int], dict[int, int], int]] = {}

        def masks_of(item: int) -> tuple[dict[int, int], dict[int, int], int]:
            if item not in masks:
                if len(masks) > 1 << 14:
                    masks.clear()
                words = bench.items[item].tolist()
                tail = max(1, round(len(words) * ANSWER_SHARE))
                made: list[dict[int, int]] = []
                for part in (words, words[-tail:]):
                    made.append({})
                    for p, w in enumerate(part):
                        made[-1][w] = made[-1].get(w, 0) | 1 << p
                masks[item] = (*made, tail)
            return masks[item]

        def near(words: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray) -> np.ndarray:
            """Which stretches of ``words`` have a window near one of their item."""
            made = -(-size // STRIDE)
            first = np.concatenate([[0], np.cumsum(made)])
            place = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            codes = words[place]
            vectors = terms[np.where(codes == OTHER, len(terms) - 1, codes % (len(terms) - 1))]
            owner = np.repeat(np.arange(len(size)), made)
            cuts = np.concatenate([[0], np.cumsum(size)[:-1]])[owner] + (np.arange(first[-1]) - first[owner]) * STRIDE
            chunk = np.add.reduceat(vectors, cuts)
            window = chunk.copy()
            for j in range(1, WIDTH // STRIDE):
                same = np.flatnonzero(owner[j:] == owner[:-j])
                window[same] += chunk[same + j]
            least = least_cosine * np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-12)
            low, n = bounds[item][owner], (bounds[item + 1] - bounds[item])[owner]
            close = np.zeros(len(owner), bool)
            for j in range(int(n.max())):
                close |= np.einsum("ij,ij->i", window, aims[low + np.minimum(j, n - 1)]) >= least
            return np.logical_or.reduceat(close, first[:-1])

        def check(words: np.ndarray, item: int, low: int, high: int) -> tuple[float, bool, int] | None:
            own, end, tail = masks_of(item)
            length, reach = len(bench.items[item]), int(bench.reach[item])
            a, b = max(0, low - reach), min(len(words), high + reach)
            part, best = words[a:b].tolist(), None
            # a window at a time, so that scattered common words do not add up to a match
            final = max(0, len(part) - reach)
            for s in [*range(0, final, max(STRIDE, length // 4)), final]:
                window = part[s : s + reach]
                share = lcs(own, length, window) / length
                if share >= PARAPHRASE_COVERAGE and (best is None or share >= best[0]):
                    answer = lcs(end, tail, window) >= 0.75 * tail
                    if (share >= LEAST_COVERAGE or answer) and (best is None or (share, answer) > best[:2]):
                        best = (share, answer, a + s)
            return best

        for part, words, at in _batches(batches, 1 << 16):
            ids, out = part.column("doc_id").to_pylist(), []
            every = list(stretches(bench, words, at))
            for k in range(0, len(every), 512):
                d, item, low, high = np.array(every[k : k + 512]).T
                begin = np.maximum(low - WIDTH, 0)
                for i in np.flatnonzero(near(words, at[d] + begin, high - begin, item)).tolist():
                    if made := check(words[at[d[i]] : at[d[i] + 1]], int(item[i]), int(low[i]), int(high[i])):
                        out.append((ids[d[i]], bench.ids[item[i]], *made))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "coverage", "answer", "at"])

    return codes.mapInArrow(run, LEAK)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; of rows with one doc_id all go or stay, rows without one are judged by their text.

    Only rows that may go are shuffled.
    """
    flag = fresh("hit", docs.columns)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = stage(leaks(docs, benchmark).select(F.col("doc_id").alias(flag)).distinct(), "leaks")
    marked = flagged(docs.where("doc_id IS NOT NULL"), bit_map(found, flag), [F.col("doc_id").cast("long")], fresh("maybe", [*docs.columns, flag]))
    maybe = F.col(fresh("maybe", [*docs.columns, flag]))
    kept = marked.where(~maybe).select(*columns).union(marked.where(maybe).select(*columns).join(found, F.col("doc_id").cast("long") == F.col(flag), "left_anti"))
    nameless = docs.where("doc_id IS NULL")
    # a row without an id is known by the hash of its text
    texts = nameless.select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    bad = stage(leaks(texts, benchmark).select(F.col("doc_id").alias(flag)).distinct(), "leaks") if not texts.isEmpty() else found.where("false")
    return kept.union(nameless.join(bad, F.xxhash64("text") == F.col(flag), "left_anti").select(*columns))
