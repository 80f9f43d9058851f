"""Many literals at once: an Aho-Corasick automaton stepped over slices of Arrow columns.

The texts of a slice are one run of bytes, cut into chunks that are stepped side by side,
each from as far before its own bytes as the longest literal is long. So one NumPy step
moves all chunks by a byte, whatever the number of literals, and every occurrence is seen
by exactly one chunk. Occurrences across the border of two texts are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK, SLICE_BYTES, BLOCK_BYTES = 1024, 1 << 20, 1 << 22
DENSE = 1 << 22  # entries of a full transition table; larger automata keep their edges only
_HASH = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class Automaton:
    """Goto, fail and output links over distinct byte literals."""

    def __init__(self, literals: Sequence[bytes]):
        self.sizes = np.array([len(x) for x in literals], np.int64)
        self.longest = int(self.sizes.max(initial=1))
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for n, literal in enumerate(literals):
            at = 0
            for byte in literal:
                following = children[at].get(byte)
                if following is None:
                    following = children[at][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                at = following
            ends[at] = n
        self.ends = np.array(ends, np.int64)
        used = sorted({b for c in children for b in c})
        self.classes = np.zeros(256, np.int64)  # all bytes that no literal has are alike
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.fail = np.zeros(len(children), np.int64)
        self.link = np.zeros(len(children), np.int64)  # the longest suffix at which a literal ends, 0 for none
        self.dense = len(children) * self.width <= DENSE
        if self.dense:
            self.table = np.zeros((len(children), self.width), np.int32)
        order = [0]
        for state in order:
            if self.dense and state:
                self.table[state] = self.table[self.fail[state]]
            for byte, child in children[state].items():
                if state:
                    back = self.fail[state]
                    while byte not in children[back] and back:
                        back = self.fail[back]
                    back = children[back].get(byte, 0)
                    self.fail[child] = back
                    self.link[child] = back if ends[back] >= 0 else self.link[back]
                if self.dense:
                    self.table[state, self.classes[byte]] = child
                order.append(child)
        self.tells = (self.ends >= 0) | (self.link > 0)
        if self.dense:
            self.table = self.table.reshape(-1)
        else:
            self._edges(children)

    def _edges(self, children: list[dict[int, int]]) -> None:
        """Edges by hashed (state, class), in as many tables as the fullest slot has edges."""
        keys = np.array([s * self.width + self.classes[b] for s, c in enumerate(children) for b in c], np.int64)
        targets = np.array([t for c in children for t in c.values()], np.int64)
        bits = len(keys).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        keys, targets, slot = keys[order], targets[order], slot[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.probes = []
        for k in range(int(nth.max(initial=0)) + 1):
            own = nth == k
            known, to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
            known[slot[own]], to[slot[own]] = keys[own], targets[own]
            self.probes.append((known, to))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _HASH) >> self.shift).astype(np.int64)

    def _step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        if self.dense:
            return self.table[states * self.width + classes]
        states, out = states.copy(), np.zeros(len(states), np.int64)
        left = np.flatnonzero(classes > 0)  # a byte of no literal leads back to the root
        while len(left):
            keys = states[left] * self.width + classes[left]
            slot = self._slot(keys)
            for known, to in self.probes:
                hit = known[slot] == keys
                out[left[hit]] = to[slot[hit]]
            # children are never the root: what has none goes on from where it fails to
            left = left[(out[left] == 0) & (states[left] > 0)]
            states[left] = self.fail[states[left]]
        return out

    def occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, literal) of all occurrences in ``data``, overlapping ones included, in no order."""
        lead, found = self.longest - 1, []
        for low in range(0, len(data), BLOCK_BYTES):
            part = data[low : low + BLOCK_BYTES]
            chunks = -(-len(part) // CHUNK)
            padded = np.zeros(lead + chunks * CHUNK, np.int64)
            before = data[max(0, low - lead) : low]
            padded[lead - len(before) : lead + len(part)] = self.classes[np.concatenate([before, part])]
            columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, lead + CHUNK)[::CHUNK].T)
            states = np.zeros(chunks, np.int64)
            for t, column in enumerate(columns):
                states = self._step(states, column)
                if t >= lead and len(hit := np.flatnonzero(self.tells[states])):
                    found.append((low + hit * CHUNK + (t - lead + 1), states[hit].astype(np.int64)))
        after = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        states = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        starts, literals = [], []
        while len(states):
            own = self.ends[states]
            ended = own >= 0
            starts.append(after[ended] - self.sizes[own[ended]])
            literals.append(own[ended])
            more = self.link[states] > 0
            after, states = after[more], self.link[states[more]]
        return (np.concatenate(starts), np.concatenate(literals)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def apart(row: np.ndarray, start: np.ndarray, literal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which occurrences, in order of literal, row and start, stand when those of a literal may not overlap: the leftmost first."""
    kept = np.ones(len(start), bool)
    same = (row[1:] == row[:-1]) & (literal[1:] == literal[:-1])
    close = np.flatnonzero(same & (start[1:] - start[:-1] < sizes[literal[1:]]))
    if not len(close):
        return kept
    fresh = np.concatenate([[True], ~same])
    group = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    for g in np.unique(group[close]):  # only literals that overlap themselves
        a, z = heads[g], heads[g + 1] if g + 1 < len(heads) else len(start)
        free, size = -1, sizes[literal[a]]
        for i in range(a, z):
            if start[i] < free:
                kept[i] = False
            else:
                free = start[i] + size
    return kept


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A text column cut by rows into runs of about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // most
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)], strict=True):
        yield column.slice(a, z - a)


class Literals:
    """Literals of several owners (rules), some compared without the case of A-Z; ``owners`` has (literal, folded, owner)."""

    def __init__(self, owners: Sequence[tuple[bytes, bool, int]]):
        self.sets = []
        for folded in (False, True):
            by: dict[bytes, list[int]] = {}
            for literal, fold, owner in owners:
                if fold == folded:
                    by.setdefault(literal.translate(bytes(FOLD)) if fold else literal, []).append(owner)
            if by:
                counts = np.array([len(x) for x in by.values()])
                self.sets.append((folded, Automaton(list(by)), np.concatenate([np.array(x, np.int64) for x in by.values()]), np.cumsum(counts) - counts, counts))

    def spans(self, column: pa.Array, overlapping: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, owner) in a text column, by row, start, end and owner, bytes; those of one literal of one owner do not overlap unless asked for."""
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, raw = column.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
        data = np.frombuffer(raw, np.uint8, offsets[-1])[offsets[0] :] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        out = []
        for folded, automaton, owners, first, counts in self.sets:
            start, literal = automaton.occurrences(FOLD[data] if folded else data)
            row = np.searchsorted(offsets, start, side="right") - 1
            inside = start + automaton.sizes[literal] <= offsets[row + 1]
            start, literal, row = start[inside], literal[inside], row[inside]
            if not overlapping:
                order = np.lexsort((start, row, literal))
                start, literal, row = start[order], literal[order], row[order]
                kept = apart(row, start, literal, automaton.sizes)
                start, literal, row = start[kept], literal[kept], row[kept]
            # each occurrence once for every owner of the literal
            n = counts[literal]
            owner = owners[np.repeat(first[literal] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            start, end, row = (np.repeat(x, n) for x in (start - offsets[row], start - offsets[row] + automaton.sizes[literal], row))
            out.append((row, start, end, owner))
        both = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((both[3], both[2], both[1], both[0]))
        return tuple(x[order] for x in both)


_known: dict[tuple, Literals] = {}


def literals_of(owners: tuple[tuple[bytes, bool, int], ...]) -> Literals:
    """One automaton for each set of literals and Python worker."""
    if owners not in _known:
        _known[owners] = Literals(owners)
    return _known[owners]
