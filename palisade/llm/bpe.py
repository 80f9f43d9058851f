"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token starts as its bytes. A segment tree over the ranks of adjacent pairs
keeps, at its root, the leftmost pair of lowest rank; merging it changes three leaves
and their ancestors, so a pre-token of n bytes costs O(n log n) even where it is a
whole document without white space.

Defined cases: a null text counts as empty, an empty text has no tokens, equal texts
have equal tokens, the string of a special token in a text is that token; repeated rows
and null ids are rows like others, an empty table gives no rows, a very long text is
coded whole. An input column named like an output column is replaced. Vocabulary files
that ask for what is not done here are refused.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import give_back, slices

CACHE_ENTRIES = 150_000
CACHED_CHARS = 48
_NONE = 1 << 62
_STEPPED, _STEP_ROWS = 33, 4096
RUN_CHARS = 1 << 19
_SPACE, _LETTER, _NUMBER, _OTHER, _BREAK = range(5)
_CUT = regex.compile(r"(?<=\S)\s")
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of hashes and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _tables or len(_tables["up"]) < n:
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(max(n, 2 * RUN_CHARS), np.uint64(base))
            table[0] = 1
            _tables[key] = np.cumprod(table, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character to byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A vocabulary file of a byte-level BPE tokenizer, ready to encode and decode."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        before = spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        odd += [k for k, plain in (("add_prefix_space", False), ("use_regex", True)) if before.get(k, True) is not plain]
        odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]
        if (spec.get("decoder") or {"type": "ByteLevel"}).get("type") != "ByteLevel":
            odd.append("decoder")
        if odd:
            raise ValueError(f"{path} sets {', '.join(odd)}, which is not supported")
        vocab = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if max([*vocab.values(), *special.values()]) >= 1 << 20:
            raise ValueError(f"{path} has ids of {1 << 20} or more")
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            if token not in special:
                self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank << 32)
            self.merged.append(vocab[a + b])
        self.merged_ids = np.array(self.merged, np.int64)
        self._tables()
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(self.PATTERN).findall
        self.cache_entries = cache_entries
        # hashes (in order) and second hashes of known pre-tokens, and where their ids stand
        self.cache = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self._kinds()

    def merge(self, raw: bytes) -> list[int]:
        """The token ids of one pre-token."""
        ids = [self.byte_id[b] for b in raw]
        n = len(ids)
        if n < 2:
            return ids
        ranks = self.ranks.get
        size = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            r = ranks(ids[i] << 20 | ids[i + 1])
            if r is not None:
                tree[size + i] = r | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) < _NONE:
            at = best & 0xFFFFFFFF
            gone = after[at]
            ids[at] = new = self.merged[best >> 32]
            follows = after[at] = after[gone]
            changes = []
            if gone < n - 1:
                changes.append((gone, _NONE))
            if follows < n:
                before[follows] = at
                r = ranks(new << 20 | ids[follows])
                changes.append((at, _NONE if r is None else r | at))
            else:
                changes.append((at, _NONE))
            if (left := before[at]) >= 0:
                r = ranks(ids[left] << 20 | new)
                changes.append((left, _NONE if r is None else r | left))
            for leaf, value in changes:
                i = size + leaf
                tree[i] = value
                i >>= 1
                while i:
                    a, b = tree[2 * i], tree[2 * i + 1]
                    value = a if a < b else b
                    if tree[i] == value:
                        break
                    tree[i] = value
                    i >>= 1
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _tables(self) -> None:
        """Ranks by hashed pair, in as many probes as the fullest slot needs, and by two bytes."""
        bits = max(16, len(self.ranks).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        keys, ranks = (np.array(list(x), np.int64) for x in (self.ranks.keys(), self.ranks.values()))
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        keys, ranks, slot = keys[order], ranks[order], slot[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.probes = []
        for k in range(int(nth.max(initial=0)) + 1):
            own = nth == k
            table = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
            table[0][slot[own]], table[1][slot[own]] = keys[own], ranks[own]
            self.probes.append(table)
        ids = np.array(self.byte_id, np.int64)
        self.byte_ranks = self._rank(np.repeat(ids, 256), np.tile(ids, 256))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, shifted to make room for a position; a sentinel where nothing merges."""
        keys = left << 20 | right
        slot, out = self._slot(keys), np.full(len(keys), _NONE, np.int64)
        for known, ranks in self.probes:
            np.copyto(out, ranks[slot], where=known[slot] == keys)
        out[(left < 0) | (right < 0)] = _NONE
        return out

    def merge_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Packed ids of pre-tokens of 2 to ``size + 1`` bytes: one segment tree for each, all merged in step.

        Rows of all tables are addressed in their flat form.
        """
        n, width = len(pieces), size + 1
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        columns = np.arange(width)
        inside = columns < lengths[:, None]
        raw = flat[np.where(inside, (np.cumsum(lengths) - lengths)[:, None] + columns, 0)]
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(inside, np.array(self.byte_id)[raw], -1)
        after = np.where(columns + 1 < lengths[:, None], columns + 1, width)
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        alive = inside.copy()
        tree = np.full((n, 2 * size), _NONE, np.int64)
        ranks = self.byte_ranks[raw[:, :size].astype(np.int64) << 8 | raw[:, 1:]]
        tree[:, size:] = np.where((ranks < _NONE) & inside[:, 1:], ranks | np.arange(size), _NONE)
        level = size >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        flat_ids, flat_after, flat_before, flat_alive, flat_tree = (x.reshape(-1) for x in (ids, after, before, alive, tree))
        depth, rows = size.bit_length() - 1, np.arange(n)
        best = tree[:, 1]
        while len(at_row := np.flatnonzero(best < _NONE)):
            rows, best = rows[at_row], best[at_row]
            wide, long, root = rows * (width + 1), rows * width, rows * (2 * size)
            at = best & 0xFFFFFFFF
            gone = flat_after[long + at]
            new = self.merged_ids[best >> 32]
            flat_ids[wide + at] = new
            flat_alive[long + gone] = False
            follows = flat_after[long + gone]
            flat_after[long + at] = follows
            flat_before[wide + follows] = at
            left = flat_before[wide + at]
            right_rank = self._rank(new, flat_ids[wide + follows])
            left_rank = self._rank(flat_ids[wide + np.maximum(left, 0)], new)
            for own, leaf, value in (
                (gone < size, gone, np.full(len(rows), _NONE)),
                (at < size, at, np.where(right_rank < _NONE, right_rank | at, _NONE)),
                (left >= 0, left, np.where(left_rank < _NONE, left_rank | left, _NONE)),
            ):
                base, i = root[own], leaf[own] + size
                flat_tree[base + i] = value[own]
                for _ in range(depth):
                    pair = base + (i & -2)
                    i = i >> 1
                    flat_tree[base + i] = np.minimum(flat_tree[pair], flat_tree[pair + 1])
            best = flat_tree[root + 1]
        packed = ids[:, :width][alive].astype("<u4").tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of pre-tokens, of each in its place."""
        raw = [p.encode() for p in pieces]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        made: list[bytes] = [b""] * len(raw)
        for i in np.flatnonzero((lengths == 1) | (lengths > _STEPPED)).tolist():
            made[i] = np.array(self.merge(raw[i]), "<u4").tobytes()
        low, size = 1, 1
        while low < _STEPPED:  # pre-tokens of low + 1 to size + 1 bytes have trees of one size
            own = np.flatnonzero((lengths > low) & (lengths <= size + 1)).tolist()
            for a in range(0, len(own), _STEP_ROWS):
                part = own[a : a + _STEP_ROWS]
                for i, ids in zip(part, self.merge_many([raw[i] for i in part], size), strict=True):
                    made[i] = ids
            low, size = size + 1, size * 2
        return made

    def _kinds(self) -> None:
        """What pre-tokens are made of, by code point: white space, letters, numbers or others; and two random numbers for each."""
        every = np.frombuffer("".join(map(chr, range(0xD800))).encode("utf-32-le") + bytes(4 * 0x800) + "".join(map(chr, range(0xE000, 0x110000))).encode("utf-32-le"), np.uint32).astype("<u4")
        self.kinds = np.full(0x110000, _OTHER, np.uint8)
        text = every.tobytes().decode("utf-32-le")
        for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, text):
                self.kinds[m.start() : m.end()] = kind
        self.values = np.random.default_rng(7).integers(1, 2**63, (2, 0x110000), dtype=np.int64).astype(np.uint64)

    def starts(self, codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Which code points begin a pre-token, as :attr:`PATTERN` has them; ``breaks`` are places between texts, pre-tokens of their own.

        A run of letters, numbers or others takes the blank before it; what is left of a run
        of white space before it is one pre-token. An apostrophe that begins a pre-token takes
        the letters of a contraction after it.
        """
        kind = self.kinds[codes]
        kind[breaks] = _BREAK
        start = np.ones(len(codes), bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start[breaks] = True
        first = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _BREAK)) + 1
        start[first - 1] = True
        start[first[codes[first - 1] == 0x20]] = False
        quote = np.flatnonzero((codes[:-1] == 0x27) & start[:-1] & (kind[1:] == _LETTER))
        if len(quote):
            one, two = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
            single = np.isin(one, [ord(c) for c in "stmd"])
            double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for taken, n in ((quote[single], 2), (quote[double & ~single], 3)):
                start[taken + 1] = False
                after = taken + n
                after = after[after < len(codes)]
                start[after[kind[after] == _LETTER]] = True
        return start

    def encode_run(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special tokens; each distinct pre-token is looked up once, by its hashes.

        Two hashes of 64 bits over random numbers tell pre-tokens apart; where one of them
        alone says that two are equal, every pre-token is encoded by itself.
        """
        joined = "\n".join(texts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        begins = np.flatnonzero(self.starts(codes, breaks))
        sizes = np.diff(begins, append=len(codes))
        token_break = np.searchsorted(begins, breaks)
        first, second = (self._hashes(codes, begins, sizes, values) for values in self.values)
        keys, pick, own = np.unique(first, return_index=True, return_inverse=True)
        checks = second[pick]
        if (second != checks[own]).any():
            return [b"".join(self.learn(self.pieces(t))) for t in texts]
        at, lengths, pool = self._looked_up(joined, begins[pick], sizes[pick], keys, checks)
        own_lengths = lengths[own]
        own_lengths[token_break] = 0
        ends = np.cumsum(own_lengths)
        ids = pool[np.repeat(at[own] - ends + own_lengths, own_lengths) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[token_break]).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    @staticmethod
    def _hashes(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """A hash of each pre-token that does not depend on where it stands."""
        up, down = _powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(values[codes] * up[: len(codes)], out=sums[1:])
        return (sums[begins + sizes] - sums[begins]) * down[begins] + sizes.astype(np.uint64)

    def _looked_up(self, joined: str, begins: np.ndarray, sizes: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, length, ids) of distinct pre-tokens in a pool, from the cache or learned; a full cache starts anew with those at hand."""
        known, known_checks, known_at, known_lengths, pool = self.cache
        place = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        hit = (known[place] == keys) & (known_checks[place] == checks) if len(known) else np.zeros(len(keys), bool)
        at, lengths = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[hit], lengths[hit] = known_at[place[hit]], known_lengths[place[hit]]
        miss = np.flatnonzero(~hit)
        made = self.learn([joined[a : a + n] for a, n in zip(begins[miss].tolist(), sizes[miss].tolist(), strict=True)])
        lengths[miss] = np.fromiter(map(len, made), np.int64, len(made)) // 4
        at[miss] = len(pool) + np.cumsum(lengths[miss]) - lengths[miss]
        both = np.concatenate([pool, np.frombuffer(b"".join(made), "<u4")])
        if len(known) > self.cache_entries:
            kept = np.flatnonzero(sizes <= CACHED_CHARS)
            ends = np.cumsum(lengths[kept])
            fresh = both[np.repeat(at[kept] - ends + lengths[kept], lengths[kept]) + np.arange(ends[-1] if len(ends) else 0)]
            self.cache = keys[kept], checks[kept], ends - lengths[kept], lengths[kept], fresh
        else:
            new = miss[sizes[miss] <= CACHED_CHARS]
            columns = [np.concatenate(x) for x in ((known, keys[new]), (known_checks, checks[new]), (known_at, at[new]), (known_lengths, lengths[new]))]
            order = np.argsort(columns[0], kind="stable")
            self.cache = *(c[order] for c in columns), both
        return at, lengths, both

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers.

        Texts are taken in runs of about ``RUN_CHARS``; longer ones are cut where white space
        follows something else, as a pre-token begins there whatever stands around it.
        """
        out: list[list[bytes]] = [[] for _ in texts]
        run: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal run, size
            for (row, _), ids in zip(run, self.encode_run([p for _, p in run]) if run else [], strict=True):
                out[row].append(ids)
            run, size = [], 0

        for row, text in enumerate(texts):
            special = text and self.split_special is not None and self.split_special.search(text)
            for part in self.split_special.split(text) if special else [text or ""]:
                if part in self.special:
                    flush()
                    out[row].append(np.array([self.special[part]], "<u4").tobytes())
                    continue
                at = 0
                while len(part) - at > RUN_CHARS and (cut := _CUT.search(part, at + RUN_CHARS)):
                    run.append((row, part[at : cut.start()]))
                    at = cut.start()
                    flush()
                run.append((row, part[at:]))
                size += len(part) - at
                if size >= RUN_CHARS:
                    flush()
        flush()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def decode(self, packed: bytes | None) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed or b"", "<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def default_path() -> str:
    """The vocabulary that the queries use; any other path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _mapped(df: DataFrame, source: str, new: dict[str, T.DataType], make) -> DataFrame:
    """``df`` with columns made from ``source`` by ``make(values) -> lists``, a bounded run of rows at a time."""
    kept = [f for f in df.schema.fields if f.name not in new]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in new.items())])
    carried = "_source" if source not in names else source
    wide = df.select(*[F.col(f"`{x}`") for x in names], *([F.col(f"`{source}`").alias("_source")] if carried == "_source" else []))
    kinds = [pa.binary() if isinstance(v, T.BinaryType) else pa.string() for v in new.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, carried, 1 << 21):
                made = make(part.column(carried).to_pylist())
                columns = [part.column(x) for x in names] + [pa.array(m, kind) for m, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        give_back()

    return wide.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with the packed token ids of every whole text (see :func:`as_array`)."""
    return _mapped(df, text, {ids: T.BinaryType()}, lambda x: (codec(path).encode_all(x),))


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its packed token ids."""
    return _mapped(df, ids, {text: T.StringType()}, lambda x: ([codec(path).decode(i) for i in x],))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass over the rows."""

    def both(texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        packed = codec(path).encode_all(texts)
        return packed, [codec(path).decode(x) for x in packed]

    return _mapped(df, text, {ids: T.BinaryType(), decoded: T.StringType()}, both)


def as_array(df: DataFrame, ids: str = "token_ids") -> DataFrame:
    """``df`` with packed ids unpacked to ``array<bigint>`` by built-in functions."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(ids) - 4, F.lit(0)), F.lit(4))
    def word(s):
        b = F.hex(F.substring(F.col(ids), s + 1, 4))
        return F.conv(F.concat(F.substring(b, 7, 2), F.substring(b, 5, 2), F.substring(b, 3, 2), F.substring(b, 1, 2)), 16, 10).cast("long")
    return df.withColumn(ids, F.when(F.octet_length(ids) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, word)))


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return round_trip(df.select("doc_id", "text"), path).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
